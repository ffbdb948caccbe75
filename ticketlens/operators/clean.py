"""Cleaning, validation and projections on tickets, requests and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import SPACE, by_domain, filled, strip, word_count


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip white space from every string column."""
    return df.select(
        *[
            strip(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null and blank texts are dropped."""
    return df.where(F.length(strip(F.col(text))) > 0)


def default_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Missing label column or null label becomes the default."""
    if label not in df.columns:
        return df.withColumn(label, F.lit(lx.DEFAULT_LABEL))
    return df.withColumn(label, F.coalesce(F.col(label), F.lit(lx.DEFAULT_LABEL)))


def normalise_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Lower, strip, anything outside the allowed set becomes the default."""
    value = F.lower(strip(F.col(label)))
    return df.withColumn(
        label, F.when(value.isin(lx.LABELS), value).otherwise(F.lit(lx.DEFAULT_LABEL))
    )


def normalise_domain(df: DataFrame, domain: str = "domain") -> DataFrame:
    """P5: lower, strip; unknown values are kept and flagged."""
    value = F.coalesce(F.lower(strip(F.col(domain))), F.lit("unknown"))
    return df.withColumn(domain, value).withColumn("domain_known", value.isin(lx.DOMAINS))


def clean_tickets(df: DataFrame) -> DataFrame:
    """P1-P5 in one projection over the scan; no shuffle."""
    out = normalise_label(default_label(drop_empty_text(trim_strings(df))))
    return normalise_domain(out) if "domain" in df.columns else out


def cleaning_report(df: DataFrame) -> DataFrame:
    """Counts of what the cleaning changes, per normalised domain."""
    text = strip(F.col("text"))
    label = F.lower(strip(F.col("label")))
    empty = F.coalesce(F.length(text) == 0, F.lit(True))
    return normalise_domain(df).groupBy("domain", "domain_known").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(~empty & ~F.coalesce(label.isin(lx.LABELS), F.lit(False))).alias(
            "n_invalid_label"
        ),
    )


def validate_requests(df: DataFrame, text: str = "text", history: str | None = None) -> DataFrame:
    """One array of reasons per request, empty when it is valid; text stripped afterwards.

    ``history`` names a column of array<struct<role, content>>.
    """
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    checks = [
        F.when(n < lx.REQUEST_MIN_CHARS, "text_too_short"),
        F.when(n > lx.REQUEST_MAX_CHARS, "text_too_long"),
    ]
    if history:
        checks += [
            F.when(
                F.exists(history, lambda h: h["role"].isNull() | h["content"].isNull()),
                "history_incomplete",
            ),
            F.when(F.exists(history, lambda h: ~h["role"].isin(lx.ROLES)), "history_role"),
        ]
    return (
        df.withColumn("reasons", F.array_compact(F.array(*checks)))
        .withColumn("valid", F.size("reasons") == 0)
        .withColumn(text, strip(F.col(text)))
    )


def validate_decisions(df: DataFrame) -> DataFrame:
    """P6 for routing records: scores in [0, 1], composition arrays of equal length."""
    in_range = lambda c: F.col(c).between(0.0, 1.0)
    return df.withColumn(
        "reasons",
        F.array_compact(
            F.array(
                F.when(~in_range("primary_score"), "primary_score"),
                F.when(~in_range("escalation_score"), "escalation_score"),
                F.when(
                    F.size("composition_domains") != F.size("composition_weights"), "composition"
                ),
            )
        ),
    ).withColumn("valid", F.size("reasons") == 0)


def build_context(
    tickets: DataFrame, turns: DataFrame, key: str, order: str = "turn", last: int = 2
) -> DataFrame:
    """The last turns as "role: text", then "user: ticket", joined by " | ".

    The per-key limit is applied before the shuffle (row_number <= n becomes a partial group
    limit), so a very long conversation never travels whole.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    recent = (
        turns.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= last)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(order, F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("t"))
                )
            ).alias("_recent")
        )
    )
    return tickets.join(recent, key, "left").select(
        *tickets.columns,
        F.when(
            F.col("_recent").isNotNull(),
            F.concat(
                F.array_join(F.transform("_recent", lambda s: s["t"]), " | "),
                F.lit(" | user: "),
                F.col("text"),
            ),
        ).otherwise(F.col("text")).alias("context"),
    )


def prompt(text: Column, domain: Column, response: Column) -> Column:
    """Prompt text; the reply part is left open when the response is empty."""
    about = by_domain(domain, lx.DOMAIN_DESCRIPTIONS, domain)
    return filled(lx.PROMPT, {"domain": about, "ticket": strip(text), "response": strip(response)})


def format_prompts(df: DataFrame) -> DataFrame:
    response = F.coalesce(F.col("response"), F.lit(""))
    return df.withColumn("prompt", prompt(F.col("text"), F.col("domain"), response))


def sft_examples(df: DataFrame, max_len: int = 512) -> DataFrame:
    """Whitespace tokens of the whole example, loss mask over the prompt part.

    ``labels`` holds -100 for prompt positions and the position itself for reply positions.
    """
    open_prompt = prompt(F.col("text"), F.col("domain"), F.lit(""))
    full = prompt(F.col("text"), F.col("domain"), F.coalesce(F.col("response"), F.lit("")))
    return (
        df.withColumn("prompt", open_prompt)
        .withColumn("full_text", full)
        .withColumn("_np", word_count(F.col("prompt")))
        .withColumn("_n", word_count(F.col("full_text")))
        .withColumn("n_prompt_tokens", F.least("_np", F.lit(max_len)).cast("bigint"))
        .withColumn("n_tokens", F.least("_n", F.lit(max_len)).cast("bigint"))
        .withColumn("truncated", F.col("_n") > max_len)
        .withColumn(
            "labels",
            F.transform(
                F.sequence(F.lit(1), F.col("n_tokens")),
                lambda i: F.when(i <= F.col("n_prompt_tokens"), F.lit(-100)).otherwise(i),
            ),
        )
        .drop("_np", "_n")
    )


def to_dpo(pairs: DataFrame) -> DataFrame:
    """P10: projection of preference pairs to (prompt, chosen, rejected)."""
    return pairs.select(F.col("text").alias("prompt"), "chosen", "rejected")


def format_eval(df: DataFrame, results: str = "results") -> DataFrame:
    """First element of a report's results, missing values as zero."""
    first = F.try_element_at(results, F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select(
        *[c for c in df.columns if c != results],
        zero(first["auto_resolution_rate"]).alias("auto_resolution_rate"),
        zero(first["unsupported_rate"]).alias("unsupported_rate"),
        zero(first["composite_score"]).alias("composite_score"),
        zero(first["p95_ms"]).alias("p95_ms"),
    )


def total_latency() -> Column:
    """Sum of the four stages."""
    return F.col("router_ms") + F.col("lora_load_ms") + F.col("generation_ms") + F.col("safety_ms")


def to_log(df: DataFrame) -> DataFrame:
    """Rounded log record with a nested latency struct and its JSON text."""
    ms = lambda c, name: F.round(c, 1).alias(name)
    record = df.select(
        "trace_id", "domain", "routing_method",
        F.round("routing_confidence", 4).alias("routing_confidence"),
        F.round("escalation_score", 4).alias("escalation_score"),
        "escalation_detected", "cache_hit", "unsupported_flagged",
        F.struct(
            ms(F.col("router_ms"), "router"), ms(F.col("lora_load_ms"), "lora_load"),
            ms(F.col("generation_ms"), "generation"), ms(F.col("safety_ms"), "safety"),
            ms(total_latency(), "total"),
        ).alias("latency_ms"),
    )
    return record.withColumn("json", F.to_json(F.struct(*record.columns)))


def parse_run_name(run: Column) -> tuple[Column, Column]:
    """(domain, rank) from a run name such as technical_r32_lr2e-04."""
    rank = F.try_element_at(
        F.filter(F.split(run, "_"), lambda t: t.rlike("^r[0-9]+$")), F.lit(1)
    )
    return (
        F.when(F.contains(run, F.lit("_")), F.split_part(run, F.lit("_"), F.lit(1))).otherwise(
            F.lit("technical")
        ),
        F.coalesce(F.substring(rank, 2, 20).cast("bigint"), F.lit(32).cast("bigint")),
    )


def ticket_cost(domain: Column) -> Column:
    return by_domain(domain, lx.COST_PER_TICKET, F.lit(lx.UNKNOWN_DOMAIN_COST))


def finalise_traces(df: DataFrame) -> DataFrame:
    """Status, cost and total latency of finished requests."""
    return (
        df.withColumn(
            "status", F.when(F.col("escalation_detected"), "escalated").otherwise("resolved")
        )
        .withColumn("cost", ticket_cost(F.col("domain")))
        .withColumn("total_ms", total_latency())
    )
