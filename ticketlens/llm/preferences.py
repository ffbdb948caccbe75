"""Preference formatting: one prompt for the turns two conversations share, two completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import table

HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def paired(turns: DataFrame) -> DataFrame:
    """Conversations 2p and 2p+1 as the chosen and the rejected side of pair p."""
    key = F.col("conv_id").cast("bigint")
    return turns.where(key.isNotNull()).select(
        F.shiftright(key, 1).alias("pair_id"),
        F.when(F.pmod(key, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        F.col("turn").cast("bigint").alias("turn"), "role", "text")


def _mark(seed: int) -> Column:
    """Order-free mark of the rows of a turn; nulls differ from empty strings."""
    return F.sum(F.xxhash64(F.struct("role", "text"), F.isnull("role"), F.isnull("text"),
                            F.lit(seed)).cast("decimal(38,0)"))


def split_turns(pairs: DataFrame) -> DataFrame:
    """(pair_id, split): the first turn in which the two sides differ, null if none does.

    A turn is compared by the number of its rows and two 64-bit marks of their roles and texts,
    summed before the shuffle: no side is collected, however many turns it has.
    """
    own = pairs.groupBy("pair_id", "turn", "side").agg(
        F.count(F.lit(1)).alias("n"), _mark(1).alias("a"), _mark(2).alias("b"))
    turns = own.groupBy("pair_id", "turn").agg(
        F.count(F.lit(1)).alias("sides"),
        *[F.min(c).eqNullSafe(F.max(c)).alias(f"same_{c}") for c in ("n", "a", "b")])
    same = (F.col("sides") == 2) & F.col("same_n") & F.col("same_a") & F.col("same_b")
    return turns.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("split"))


def preference_segments(pairs: DataFrame) -> DataFrame:
    """Rendered segments of all pairs (pair_id, side, turn, role, text).

    Returns pair_id, part (prompt, chosen, rejected), turn, role, segment, loss_from, loss_to.
    The turns before the first difference are the prompt and are emitted once, from the chosen
    side; the others are completions of their sides.  A segment is the turn between its marks;
    loss_from and loss_to bound the code points that are trained on, text and end mark of a
    completion's assistant turns; both are 0 where nothing is.  A prompt, a completion is its
    segments in the order of turn, role and segment.

    Turns need not be consecutive.  Several rows with one turn number are compared as a bag.
    Null roles read `unknown`, null texts are empty; a null turn number stands behind all others
    and is never part of a prompt.  A side without partner is a completion from its first turn.
    Identical sides are prompt only.
    """
    last = F.lit((1 << 63) - 1)
    turn = F.coalesce("turn", last)
    placed = pairs.withColumn("turn", turn)
    cut = split_turns(placed)
    rows = placed.join(cut, "pair_id")
    shared = (F.col("turn") < F.coalesce("split", last)) & (F.col("turn") < last)
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD.split("{role}")[0]), role, F.lit(HEAD.split("{role}")[1]))
    trained = ~shared & (role == TRAINED_ROLE)
    return rows.where(~shared | (F.col("side") == "chosen")).select(
        "pair_id", F.when(shared, "prompt").otherwise(F.col("side")).alias("part"),
        F.when(F.col("turn") < last, F.col("turn")).alias("turn"), role.alias("role"),
        F.concat(head, text, F.lit(TAIL)).alias("segment"),
        F.when(trained, F.length(head)).otherwise(0).cast("bigint").alias("loss_from"),
        F.when(trained, F.length(head) + F.length(text) + len(TAIL)).otherwise(0).cast("bigint").alias("loss_to"))


def op3_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference_segments(paired(table(spark, sf_dir, "conversations")))


ORACLE = r"""
with t as (
  select (conv_id // 2)::bigint as pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end as side,
         coalesce(turn::bigint, 9223372036854775807) as turn, role, text
  from conversations where conv_id is not null),
own as (
  select pair_id, turn, side,
         list_sort(list(struct_pack(r := role is null, rr := coalesce(role, ''), t := text is null, tt := coalesce(text, '')))) as x
  from t group by all),
turns as (
  select pair_id, turn, count(*) = 2 and min(x) = max(x) as same from own group by all),
cut as (select pair_id, min(turn) filter (not same) as split from turns group by pair_id),
s as (
  select t.*, turn < coalesce(split, 9223372036854775807) and turn < 9223372036854775807 as shared,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as head,
         coalesce(role, 'unknown') as name, coalesce(text, '') as body
  from t join cut using (pair_id))
select pair_id, case when shared then 'prompt' else side end as part,
       case when turn < 9223372036854775807 then turn end as turn, name as role,
       head || body || '<|end|>' || chr(10) as segment,
       case when not shared and name = 'assistant' then length(head) else 0 end::bigint as loss_from,
       case when not shared and name = 'assistant' then length(head) + length(body) + 8 else 0 end::bigint as loss_to
from s where not shared or side = 'chosen'
"""
