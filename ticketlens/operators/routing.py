"""Vector-based routing with keyword fallback, adapter selection and ticket processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions import text as tx
from ticketlens.functions.vectors import as_double, dot, l2_norm
from ticketlens.operators.clean import ticket_cost
from ticketlens.operators.safety import run_filters
from ticketlens.plans.scale import broadcast_checked, evaluate_once

MAX_PROTOTYPES = 256
TEMPERATURE = 0.10


class Prototypes:
    """A bounded set of (domain, vector) rows carried as literals of the plan."""

    def __init__(self, df: DataFrame, domain: str = "domain", vector: str = "prototype"):
        rows = df.select(domain, as_double(F.col(vector)).alias("v")).limit(
            MAX_PROTOTYPES + 1).collect()
        if len(rows) > MAX_PROTOTYPES:
            raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
        order = {d: i for i, d in enumerate(lx.DOMAINS)}
        rows.sort(key=lambda r: (order.get(r[0], len(order)), r[0]))
        self.domains = [r[0] for r in rows]
        self.vectors = []
        for r in rows:
            norm = sum(x * x for x in r[1]) ** 0.5
            self.vectors.append([x / norm if norm else 0.0 for x in r[1]])

    def position(self, domain: str) -> int | None:
        return self.domains.index(domain) if domain in self.domains else None


def similarities(df: DataFrame, protos: Prototypes, vector: str = "v", prefix: str = "_s"):
    """Cosine with every prototype, one column per prototype.

    Scalar columns keep everything after the dot products inside generated code.
    """
    v = as_double(F.col(vector))
    out = df.withColumn("_norm", l2_norm(v))
    return out.withColumns(
        {
            f"{prefix}{i}": F.when(F.col("_norm") > 0, dot(v, F.lit(p)) / F.col("_norm"))
            .otherwise(F.lit(0.0))
            for i, p in enumerate(protos.vectors)
        }
    ).drop("_norm")


def score_tickets(df: DataFrame, protos: Prototypes, text: str = "text", vector: str = "v"):
    """Keyword score and similarities, each computed once per ticket.

    The escalation similarity is at least a positive keyword score.
    """
    out = similarities(df.withColumn("keyword_score", tx.escalation_score(F.col(text))), protos,
                       vector)
    out = evaluate_once(
        out, ["keyword_score", *[f"_s{i}" for i in range(len(protos.domains))]])
    at = protos.position("escalation")
    if at is None:
        return out
    s, kw = F.col(f"_s{at}"), F.col("keyword_score")
    return out.withColumn(f"_s{at}", F.when(kw > 0, F.greatest(s, kw)).otherwise(s))


def _largest(prefix: str, n: int) -> Column:
    cols = [F.col(f"{prefix}{i}") for i in range(n)]
    return F.greatest(*cols) if n > 1 else cols[0]


def softmax(df: DataFrame, n: int, temperature, scores: str = "_s", out: str = "_p"):
    """Temperature softmax with the maximum subtracted, over n score columns."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    t = F.greatest(t, F.lit(1e-6))
    df = df.withColumn("_peak", _largest(scores, n))
    df = df.withColumns(
        {f"_e{i}": F.exp((F.col(f"{scores}{i}") - F.col("_peak")) / t) for i in range(n)})
    total = F.col("_e0")
    for i in range(1, n):
        total = total + F.col(f"_e{i}")
    df = df.withColumn("_total", total)
    df = df.withColumns({f"{out}{i}": F.col(f"_e{i}") / F.col("_total") for i in range(n)})
    df = df.drop("_peak", "_total", *[f"_e{i}" for i in range(n)])
    return evaluate_once(df, [f"{out}{i}" for i in range(n)])


def argmax(protos: Prototypes, prefix: str = "_p") -> tuple[Column, Column]:
    """(domain, value) of the largest column; the first one wins a tie."""
    top = _largest(prefix, len(protos.domains))
    choice = None
    for i, d in enumerate(protos.domains):
        hit = F.col(f"{prefix}{i}") == top
        choice = F.when(hit, d) if choice is None else choice.when(hit, d)
    return choice, top


def ranked(scores: list[Column], domains: list[str]) -> Column:
    """Array of struct(domain, score, rank), best first, ties in prototype order."""
    ordered = F.array_sort(
        F.array(
            *[
                F.struct((-c).alias("neg"), F.lit(i).alias("i"), F.lit(d).alias("domain"))
                for i, (c, d) in enumerate(zip(scores, domains))
            ]
        )
    )
    return F.transform(
        ordered,
        lambda x, r: F.struct(
            x["domain"].alias("domain"), F.round(-x["neg"], 4).alias("score"),
            (r + 1).alias("rank"),
        ),
    )


def _threshold(domain: Column) -> Column:
    return tx.by_domain(domain, lx.CONFIDENCE_THRESHOLDS, F.lit(0.70))


def _fallback(df: DataFrame, protos: Prototypes, text: str) -> DataFrame:
    """Strong keywords, else the keyword domain, else the best domain again."""
    kw, kwd, sure = F.col("keyword_score"), F.col("_kw_domain"), F.col("is_confident")
    strong = kw >= lx.FALLBACK_ESCALATION
    df = df.withColumn("_kw_domain", tx.keyword_domain(F.col(text)))
    df = df.withColumns(
        {
            "_target": F.when(sure, F.col("_best")).when(strong, "escalation")
            .otherwise(F.coalesce(kwd, F.col("_best"))),
            "routing_method": F.when(sure, "semantic")
            .when(strong | kwd.isNotNull(), "keyword").otherwise("zero_shot"),
            "_raise": F.when(sure, F.lit(0.0)).when(strong, kw)
            .when(kwd.isNotNull(), F.lit(lx.FALLBACK_DOMAIN_SCORE)).otherwise(F.lit(0.0)),
        }
    )
    df = df.withColumns(
        {
            f"_p{i}": F.when(F.col("_target") == d, F.greatest(f"_p{i}", "_raise"))
            .otherwise(F.col(f"_p{i}"))
            for i, d in enumerate(protos.domains)
        }
    )
    raised = tx.by_domain(
        F.col("_target"), {d: F.col(f"_p{i}") for i, d in enumerate(protos.domains)},
        F.col("_raise"))
    changed = F.col("_target") != F.col("_best")
    return df.withColumns(
        {
            "fallback_triggered": changed,
            "primary_score": F.when(changed, raised).otherwise(F.col("_best_score")),
            "primary_domain": F.col("_target"),
        }
    )


def route(
    df: DataFrame,
    protos: Prototypes,
    temperature: float = TEMPERATURE,
    fallback: bool = True,
    text: str = "text",
    vector: str = "v",
    force_domain: str | None = None,
) -> DataFrame:
    """R7 (R8 with fallback=False, R9 for rows with a forced domain).

    Map-only: prototypes are literals of the plan and every score is a column.
    """
    n = len(protos.domains)
    esc = protos.position("escalation")
    scored = softmax(score_tickets(df, protos, text, vector), n, temperature)
    best_domain, best_score = argmax(protos)
    best = scored.withColumns({"_best": best_domain, "_best_score": best_score})
    best = best.withColumn("is_confident", F.col("_best_score") >= _threshold(F.col("_best")))
    if fallback:
        best = _fallback(best, protos, text)
    else:
        best = best.withColumns(
            {
                "primary_domain": F.col("_best"), "primary_score": F.col("_best_score"),
                "routing_method": F.lit("semantic"), "fallback_triggered": F.lit(False),
            }
        )
    kw = F.col("keyword_score")
    esc_prob = F.col(f"_p{esc}") if esc is not None else F.lit(0.0)
    values = {
        "all_scores": ranked([F.col(f"_p{i}") for i in range(n)], protos.domains),
        "escalation_detected": (F.col("primary_domain") == "escalation")
        | (kw >= lx.ESCALATION_THRESHOLD),
        "escalation_score": F.round(F.greatest(esc_prob, kw), 4),
        "primary_score": F.round("primary_score", 4),
        "ticket_length": F.length(text),
    }
    if force_domain:
        forced = F.col(force_domain)
        to_esc = forced == "escalation"
        fixed = [F.when(forced == d, F.lit(0.99)).otherwise(F.lit(0.05)) for d in protos.domains]
        overrides = {
            "all_scores": ranked(fixed, protos.domains),
            "primary_domain": forced,
            "primary_score": F.lit(0.99),
            "routing_method": F.lit("default"),
            "escalation_detected": to_esc,
            "escalation_score": F.when(to_esc, F.lit(0.99)).otherwise(F.lit(0.01)),
            "is_confident": F.lit(True),
            "fallback_triggered": F.lit(False),
        }
        for name, value in overrides.items():
            values[name] = F.when(forced.isNotNull(), value).otherwise(
                values.get(name, F.col(name)))
    out = best.withColumns(values)
    out = out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])
    return evaluate_once(out, [c for c in out.columns if c not in df.columns])


def runner_up(scores: str = "all_scores") -> Column:
    """Second-best domain, null when there is only one."""
    return F.try_element_at(scores, F.lit(2))["domain"]


def confidence_gap(scores: str = "all_scores", primary: str = "primary_score") -> Column:
    """Gap between the two best scores, the primary score when there is one."""
    first = F.try_element_at(scores, F.lit(1))["score"]
    second = F.try_element_at(scores, F.lit(2))["score"]
    return F.coalesce(first - second, F.col(primary))


def default_registry(spark) -> DataFrame:
    rows = [(d, lx.DEFAULT_ADAPTERS[d], lx.DEFAULT_RANKS[d]) for d in lx.DOMAINS]
    return spark.createDataFrame(rows, "domain string, adapter_path string, lora_rank int")


def registry(best_checkpoints: DataFrame) -> DataFrame:
    """Best checkpoint path per known domain, the default path where there is none."""
    defaults = default_registry(best_checkpoints.sparkSession)
    best = best_checkpoints.where(F.col("domain").isin(lx.DOMAINS)).select(
        "domain", F.col("adapter_path").alias("_path"))
    return defaults.join(best, "domain", "left").select(
        "domain", F.coalesce("_path", "adapter_path").alias("adapter_path"), "lora_rank")


def select_adapter(
    decisions: DataFrame,
    adapters: DataFrame | None = None,
    composition_gap: float = lx.COMPOSITION_GAP,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Adapter, composition, reason and human-escalation flag per decision."""
    adapters = default_registry(decisions.sparkSession) if adapters is None else adapters
    p, s = F.col("primary_domain"), F.col("primary_score")
    limit = tx.by_domain(p, thresholds or lx.CONFIDENCE_THRESHOLDS, F.lit(0.70))
    second, gap = F.col("runner_up"), F.col("confidence_gap")
    rule = (
        F.when(F.col("escalation_detected"), "escalation_override")
        .when(s < lx.LOW_CONFIDENCE, "low_confidence")
        .when(
            (s >= limit) & second.isNotNull() & (second != "escalation")
            & (gap < composition_gap),
            "composed",
        )
        .when(s >= limit, "confident")
        .otherwise("below_threshold")
    )
    score_of = lambda d: F.coalesce(
        F.try_element_at(F.filter("all_scores", lambda x: x["domain"] == d), F.lit(1))["score"],
        F.lit(0.0),
    )
    chosen = (
        decisions.withColumn("runner_up", runner_up())
        .withColumn("confidence_gap", confidence_gap())
        .withColumn("selection_rule", rule)
        .withColumn(
            "selected_domain",
            F.when(F.col("selection_rule").isin("escalation_override", "low_confidence"),
                   "escalation").otherwise(p),
        )
        .withColumn("fallback_used",
                    F.col("selection_rule").isin("low_confidence", "below_threshold"))
        .withColumn("_wp", score_of(p))
        .withColumn("_ws", score_of(second))
    )
    chosen = evaluate_once(
        chosen, ["runner_up", "confidence_gap", "selection_rule", "selected_domain",
                 "fallback_used", "_wp", "_ws"])
    total = F.col("_wp") + F.col("_ws") + 1e-9
    composed = F.col("selection_rule") == "composed"
    reason = (
        F.when(F.col("selection_rule") == "escalation_override",
               F.format_string("escalation score %.3f overrides the primary domain",
                               "escalation_score"))
        .when(F.col("selection_rule") == "low_confidence",
              F.format_string("primary score %.3f is under 0.4, a person decides", s))
        .when(composed,
              F.format_string("%s at %.1f%% with %s at %.1f%%, as their gap %.3f is under %.2f", p, F.col("_wp") / total * 100, second,
                              F.col("_ws") / total * 100, gap, F.lit(composition_gap)))
        .when(F.col("selection_rule") == "confident",
              F.format_string("%s at %.3f, not under %.2f", p, s,
                              limit))
        .otherwise(F.format_string("%s at %.3f as fallback, under %.2f", p, s, limit))
    )
    out = (
        chosen.withColumn("selection_reason", reason)
        .withColumn("composition_domains", F.when(composed, F.array(p, second))
                    .otherwise(F.array().cast("array<string>")))
        .withColumn(
            "composition_weights",
            F.when(composed, F.array(F.round(F.col("_wp") / total, 4),
                                     F.round(F.col("_ws") / total, 4)))
            .otherwise(F.array().cast("array<double>")),
        )
        .withColumn(
            "needs_human",
            ((F.col("selected_domain") == "escalation")
             & (F.col("escalation_score") >= lx.HUMAN_ESCALATION_SCORE))
            | (F.col("fallback_used") & (s < lx.LOW_CONFIDENCE)),
        )
        .drop("_wp", "_ws")
    )
    small = adapters.withColumnRenamed("domain", "selected_domain")
    return out.join(broadcast_checked(small, MAX_PROTOTYPES), "selected_domain", "left")


def repeated_contact(
    df: DataFrame, min_contacts: int = 3, hours: int = 48, customer: str = "customer_id",
    ts: str = "ts",
) -> DataFrame:
    """Contacts of the customer in the trailing window and the flag.

    Time is cut into buckets as long as the window; a contact counts in its own bucket and is
    carried into the next one, so a busy customer spreads over as many groups as the time span
    has buckets.
    """
    span = hours * 3_600_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = df.withColumn("_us", micros).withColumn(
        "_own", F.floor(F.col("_us") / span).cast("bigint")
    ).withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    trailing = (
        Window.partitionBy(customer, "_bucket").orderBy("_us").rangeBetween(-span, 0)
    )
    return (
        placed.withColumn("n_contacts", F.count(F.lit(1)).over(trailing))
        .where(F.col("_bucket") == F.col("_own"))
        .withColumn("repeated_contact", F.col("n_contacts") >= min_contacts)
        .drop("_us", "_own", "_bucket")
    )


def process_tickets(
    df: DataFrame, protos: Prototypes, adapters: DataFrame | None = None, key: str = "ticket_id",
    **routing,
) -> DataFrame:
    """Route, select, filter the candidate response, build the response record.

    Needs columns text, v and response; works on batch and streaming frames.
    """
    selected = select_adapter(route(df, protos, **routing), adapters)
    filtered = run_filters(
        selected.withColumn("_true_domain", F.col("domain")).withColumn(
            "domain", F.col("primary_domain"))
        if "domain" in df.columns
        else selected.withColumn("domain", F.col("primary_domain")),
        key=key,
    )
    out = filtered.withColumn(
        "status", F.when(F.col("escalation_triggered"), "escalated").otherwise("resolved")
    ).withColumn("cost", ticket_cost(F.col("primary_domain")))
    if "domain" in df.columns:
        out = out.withColumn("domain", F.col("_true_domain")).drop("_true_domain")
    return out
