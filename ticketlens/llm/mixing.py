"""Mixing sources to target weights along a curriculum whose weights change with time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import WORD_PATTERN, table, written
from ticketlens.llm.ranks import running_totals

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating (fixed by the contract)
SHARE_PERCENT = 150  # of all sizes
MOST_PASSES = 2
MOST_SOURCES = 100_000  # sources are a dimension; more than this is an error, never a cut
#: relative weight at the start and at the end of the schedule, by place of the source
RAMPS = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
SEED = "curriculum"


def targets_of(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float, int]]:
    """(source, size, target, place) with sources by code point and null last.

    The share is dealt out by weight; a source that would get more than MOST_PASSES times its
    size gets just that, and the excess is dealt among the others until none is above.
    """
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))]
    cap = [float(MOST_PASSES * s) for _, s in rows]
    left, target = SHARE_PERCENT * sum(s for _, s in rows) / 100.0, [0.0] * len(rows)
    # in the order in which sources reach their caps as the level rises
    order = sorted(range(len(rows)), key=lambda k: cap[k] / weight[k])
    rest = sum(weight)
    for k in order:
        target[k] = min(cap[k], left * weight[k] / rest)
        left, rest = left - target[k], rest - weight[k]
    return [(*rows[k], target[k], k) for k in range(len(rows))]


def demand_time(done: Column, start: Column, end: Column) -> Column:
    """Time in [0, 1] at which a source has been asked for the share `done` of its target.

    The weight runs straight from `start` to `end`, so its integral is a parabola; this is the
    stable root of that parabola.
    """
    mean = (start + end) / 2
    c = done * mean
    return F.least(F.lit(1.0), 2 * c / (start + F.sqrt(F.greatest(
        F.lit(0.0), start * start + 2 * (end - start) * c))))


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per input row (doc_id, text, source): size, target, words taken, positions.

    Columns: doc_id, source, size, source_size, target, taken, taken_1, taken_2 (words taken in
    the first and the second pass over the source), position_1, position_2 (training time of the
    first word of a pass, null if nothing is taken).  Within a source, documents follow a hash
    of their key.  A pass takes whole documents until the source's target, rounded to words, is
    met; only the last document is taken in part.  With `carry` the input's other columns follow,
    kept apart in the struct column `row`.  Null or empty texts have size 0 and take
    nothing; a null source is a source of its own; repeated rows are taken one by one.
    """
    words = F.regexp_count("text", F.lit(WORD_PATTERN))
    columns = ["doc_id", "source", F.coalesce(words, F.lit(0)).cast("bigint").alias("size"),
               F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
               F.xxhash64("text").alias("_x")]
    # without the rows that are carried, which are read again where they are placed
    sized = written(docs.select(*columns), "mix-sizes")
    groups = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = groups.limit(MOST_SOURCES + 1).collect()  # a checked dimension
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = docs.sparkSession
    plan = [(k, s, n, t, int(math.floor(t + 0.5)), *map(float, RAMPS[k % len(RAMPS)]))
            for s, n, t, k in targets_of([(r["source"], r["size"]) for r in found])]
    plan = spark.createDataFrame(
        plan, "_k int, _source string, source_size bigint, target double, _goal bigint, _a double, _b double")
    planned = lambda df: df.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    full = docs.select(*columns, F.struct(*docs.columns).alias("row")) if carry else sized
    placed = running_totals(planned(full), F.col("_k"), "_h", {"_before": "size"}, ["doc_id", "size", "_x"],
                            sum(r["n"] for r in found), planned(sized))

    def part(pass_no: int) -> Column:
        ahead = F.col("_before") + pass_no * F.col("source_size")
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - ahead)).cast("bigint")

    def position(pass_no: int) -> Column:
        ahead = F.col("_before") + pass_no * F.col("source_size")
        at = demand_time(ahead / F.greatest(F.lit(1), F.col("_goal")), F.col("_a"), F.col("_b"))
        return F.when(part(pass_no) > 0, at)

    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (part(0) + part(1)).alias("taken"), part(0).alias("taken_1"), part(1).alias("taken_2"),
        position(0).alias("position_1"), position(1).alias("position_2"), *(["row"] if carry else []))


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that are not taken stand last."""
    return mixed.orderBy(F.asc_nulls_last("position_1"), "doc_id")


def scheduled(docs: DataFrame) -> DataFrame:
    """The mix as rows of the input's columns: one for each pass of a document, by position.

    The one document per source that the target cuts ends behind its last word that is taken.
    """
    passes = F.filter(
        F.array(*[F.struct(F.col(f"taken_{k}").alias("n"), F.col(f"position_{k}").alias("at"))
                  for k in (1, 2)]), lambda x: x["n"] > 0)
    # every piece but a blank last one holds one word and the white space before it
    pieces = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    kept = F.array_join(F.slice(pieces, 1, F.col("_pass.n").cast("int")), "")
    text = F.when(F.col("_pass.n") < F.col("size"), kept).otherwise(F.col("row.text"))
    rows = mix(docs, carry=True).withColumn("_pass", F.explode(passes))
    return rows.orderBy("_pass.at", "doc_id").select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_curriculum_mixing(spark, sf_dir: str) -> DataFrame:
    return by_position(mix(table(spark, sf_dir, "documents")))


ORACLE = r"""
with sized as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('curriculum|' || coalesce(doc_id::varchar, '')) as h
  from documents),
groups as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, row_number() over (order by source is null, source) - 1 as k from groups),
weighted as (
  select *, case k % 3 when 0 then 3 when 1 then 1 else 2 end::double as weight,
         2.0 * source_size as cap from ranked),
levels as (
  select *, sum(cap) over w as caps_before, sum(weight) over w as weights_before,
         sum(weight) over () as weights, sum(source_size) over () * 1.5 as total
  from weighted
  window w as (order by cap / weight, k rows between unbounded preceding and 1 preceding)),
open as (
  select max((total - coalesce(caps_before, 0)) / (weights - coalesce(weights_before, 0)))
           filter (cap / weight >= (total - coalesce(caps_before, 0)) / (weights - coalesce(weights_before, 0)))
           as level from levels),
targets as (
  select source, k, source_size, least(cap, weight * (select level from open)) as target from weighted),
placed as (
  select s.*, t.k, t.source_size, t.target, floor(t.target + 0.5)::bigint as goal,
         coalesce(sum(s.size) over (partition by t.k order by s.h, s.doc_id
                  rows between unbounded preceding and 1 preceding), 0)::bigint as before,
         case t.k % 3 when 0 then 1.5 when 1 then 0.5 else 1.0 end as a,
         case t.k % 3 when 0 then 0.5 when 1 then 1.5 else 1.0 end as b
  from sized s join targets t on s.source is not distinct from t.source),
taken as (
  select *, greatest(0, least(size, goal - before)) as taken_1,
         greatest(0, least(size, goal - before - source_size)) as taken_2,
         before / greatest(1, goal) * (a + b) / 2 as c1,
         (before + source_size) / greatest(1, goal) * (a + b) / 2 as c2
  from placed)
select doc_id, source, size, source_size, target, (taken_1 + taken_2)::bigint as taken,
       taken_1::bigint as taken_1, taken_2::bigint as taken_2,
       case when taken_1 > 0 then least(1.0, 2 * c1 / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * c1)))) end as position_1,
       case when taken_2 > 0 then least(1.0, 2 * c2 / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * c2)))) end as position_2
from taken
"""
