"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows are cut into blocks of about ``block_chars`` characters. With integer weights w
of total W a source's block i is released at slot floor(i * W / w) and due by ceil((i + 1) * W / w).
In each slot the released block with the earliest deadline runs, which keeps every source within
less than one block of its share at all times. The schedule repeats after W slots, so of one period of
it the slots up to the latest deadline of the corpus's blocks are all that has to be worked out.

Sources of one weight have the same releases and deadlines, so they take turns in the order of their
names: the schedule walks a queue per weight, not per source. A period of any length goes through in
segments of ``SEGMENT`` slots, each a row that takes up the state that the one before it left.

Rows are numbered within a source by two levels of prefix sums: within (source, salt, range of ids)
groups, and over the groups' totals, so no task ever holds a whole source.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import chunked_walk, let, stage

BLOCK_CHARS = 65_536
#: Slots of a period that one row holds at a time.
SEGMENT = 1 << 18
#: Ids that a group of rows spans at most.
ID_RANGE = 1 << 26


def _key(source: str = "source") -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that aren't negative, exact for all longs."""
    return F.call_function("div", a, b)


def weighted(keys: DataFrame, weights: dict[str, int], default_weight: int) -> DataFrame:
    """``keys`` (a row each) with the weight of each source, divided by the weights' common divisor: in
    so many times fewer slots every source has run the same blocks, so the schedule is the same."""
    named = keys.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(weights)), "map<string,bigint>")).alias("name", "weight"))
    named = named.select(F.concat(F.lit("="), "name").alias("key"), "weight")
    found = keys.join(named, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(default_weight).cast("long")))
    used = [r.weight for r in found.select("weight").distinct().collect()]  # values of ``weights`` and the default
    return found.withColumn("weight", _div(F.col("weight"), F.lit(math.gcd(*used) or 1).cast("long")))


def latest_deadline(sources: DataFrame) -> int:
    """Slots by which all blocks of ``sources`` (key, weight, blocks) are done, one period at most."""
    total = sources.agg(F.sum("weight")).first()[0] or 0
    need = F.when(F.col("blocks") >= F.col("weight"), F.lit(total)).otherwise(_div(F.col("blocks") * F.lit(total) + F.col("weight") - 1, F.col("weight")))
    return sources.agg(F.max(need)).first()[0] or 0


def schedule(sources: DataFrame, slots: int | None = None) -> DataFrame:
    """``sources`` (key, weight; a row each) to one period, or its first ``slots``: key, seq (its block), slot, period.

    Ties of deadlines go to the earlier release, then the smaller key. The time grows with the
    slots times the number of different weights; the memory doesn't grow with the period.
    """
    keys = F.sort_array(F.collect_list("key")).alias("members")
    queues = sources.groupBy("weight").agg(keys).agg(
        F.sort_array(F.collect_list(F.struct("weight", "members"))).alias("queues"), F.sum(F.col("weight") * F.size("members")).alias("period")
    )
    state = stage(queues.where("period > 0").withColumn("done", F.transform("queues", lambda _: F.lit(0).cast("long"))), "mix-queues")
    first = state.select("period").first()
    if first is None:
        return sources.select("key", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("period")).limit(0)
    out, end = None, first.period if slots is None else min(slots, first.period)
    for begin in range(0, end, SEGMENT):
        walked = stage(state.withColumn("walk", _segment(begin, min(SEGMENT, end - begin))), "mix-segment")
        ran = walked.select("period", F.posexplode("walk.out").alias("slot", "o")).select(
            F.col("o.weight").alias("weight"), F.col("o.n").alias("n"), (F.col("slot") + F.lit(begin)).cast("long").alias("slot"), "period"
        )
        out = ran if out is None else out.unionByName(ran)
        state = walked.select("queues", "period", F.col("walk.state").alias("done"))
    by_weight = Window.partitionBy("weight")
    turns = sources.select("key", "weight", (F.row_number().over(by_weight.orderBy("key")) - 1).cast("long").alias("turn"), F.count("*").over(by_weight).alias("of"))
    of = F.col("of")
    return out.join(turns, (out.weight == turns.weight) & (out.n % of == turns.turn)).select("key", _div(F.col("n"), of).alias("seq"), "slot", "period")


def _segment(begin: int, slots: int) -> Column:
    """The walk over slots begin .. begin + slots: (state, out) from the columns queues, period, done."""
    period = F.col("period")

    def step(done: Column, t: Column) -> Column:
        def head(q: Column, i: Column) -> Column:
            def of(n: Column) -> Column:
                seq = _div(n, F.size(q.members).cast("long"))
                release = _div(seq * period, q.weight)
                due = _div((seq + 1) * period + q.weight - 1, q.weight)
                key = F.get(q.members, (n % F.size(q.members)).cast("int"))
                return F.when(release <= t, F.struct(due.alias("due"), release.alias("release"), key.alias("key"), i.alias("i"), q.weight.alias("weight"), n.alias("n")))

            return let(F.get(done, i), of)

        return let(
            F.array_min(F.transform("queues", head)),
            lambda best: F.struct(
                F.transform(done, lambda n, i: n + (i == best.i).cast("long")).alias("state"), F.struct(best.weight.alias("weight"), best.n.alias("n")).alias("out")
            ),
        )

    return chunked_walk(F.sequence(F.lit(begin).cast("long"), F.lit(begin + slots - 1).cast("long")), F.col("done"), step, "struct<weight:bigint,n:bigint>")


def mix(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``block`` (within its source), ``slot`` (in the whole mixture) and ``place``; these
    replace columns of the same names.

    No row is dropped: ``slot`` is the block's place in the mixture, and a source that ends early
    leaves its later slots empty. ``place`` is the row's first character within its source; rows
    read in the order (slot, place, doc_id) are the mixture. A source that ``weights`` doesn't name
    has ``default_weight``; a null source is a source of its own. Null and empty texts have length
    0 and fall into the block that is open. Repeated rows and ties are all kept; an empty table
    gives no rows. Weights are positive integers of any total. The sources' names have to fit in one
    row of a table.
    """
    placed = _placed(docs, weights, default_weight, block_chars)
    new = {"block": "_mix_block", "slot": "_mix_slot", "place": "_mix_place"}
    return placed.select(*[F.col(c) for c in docs.columns if c not in new], *[F.col(c).alias(k) for k, c in new.items()])


def _placed(docs: DataFrame, weights: dict[str, int], default_weight: int, block_chars: int) -> DataFrame:
    """``docs`` with _mix_block, _mix_slot and _mix_place."""
    if any(not isinstance(w, int) or w < 1 for w in [*weights.values(), default_weight]):
        raise ValueError("weights must be positive integers")
    group = ["_mix_src_", "_mix_salt_", "_mix_range_"]
    salted = (
        docs.withColumn("_mix_src_", _key())
        .withColumn("_mix_salt_", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2))
        .withColumn("_mix_range_", F.coalesce(F.floor(F.col("doc_id") / ID_RANGE), F.lit(-(1 << 62))).cast("long"))
        .withColumn("_mix_len_", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    )
    totals = stage(salted.groupBy(*group).agg(F.sum("_mix_len_").alias("_mix_sum_")), "mix-totals")
    before = Window.partitionBy("_mix_src_").orderBy("_mix_salt_", "_mix_range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, F.coalesce(F.sum("_mix_sum_").over(before), F.lit(0)).alias("_mix_base_"))
    within = Window.partitionBy(*group).orderBy("doc_id", F.md5(F.col("text").cast("binary"))).rowsBetween(Window.unboundedPreceding, -1)
    # an empty text behind the last character may open one block more
    blocks = totals.groupBy(F.col("_mix_src_").alias("key")).agg((F.floor(F.sum("_mix_sum_") / block_chars) + 1).alias("blocks"))
    sources = stage(weighted(blocks, weights, default_weight), "mix-sources")
    period = stage(schedule(sources.select("key", "weight"), latest_deadline(sources)), "mix-period").select(
        F.col("key").alias("_mix_src_"), F.col("seq").alias("_mix_seq_"), F.col("slot").alias("_mix_slot_"), F.col("period").alias("_mix_period_")
    )
    return (
        salted.withColumn("_mix_in_", F.coalesce(F.sum("_mix_len_").over(within), F.lit(0)))
        .join(offsets, group)
        .withColumn("_mix_place", F.col("_mix_base_") + F.col("_mix_in_"))
        .withColumn("_mix_block", F.floor(F.col("_mix_place") / block_chars))
        .join(sources.select(F.col("key").alias("_mix_src_"), F.col("weight").alias("_mix_weight_")), "_mix_src_")
        .withColumn("_mix_seq_", F.col("_mix_block") % F.col("_mix_weight_"))
        .join(period, ["_mix_src_", "_mix_seq_"])
        .withColumn("_mix_slot", _div(F.col("_mix_block"), F.col("_mix_weight_")) * F.col("_mix_period_") + F.col("_mix_slot_"))
        .select(*docs.columns, "_mix_block", "_mix_slot", "_mix_place")
    )


def mixture(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, its own columns only.

    Nulls, empty texts, repeated rows and empty tables are as in ``mix``: every row comes back once.
    """
    mixed = _placed(docs, weights, default_weight, block_chars)
    return mixed.repartitionByRange("_mix_slot", "_mix_place").sortWithinPartitions("_mix_slot", "_mix_place", "doc_id").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE src AS (
  SELECT source, 1 + CAST(substr(source, 4) AS BIGINT) % 4 AS w, row_number() OVER (ORDER BY source) - 1 AS k
  FROM (SELECT DISTINCT source FROM documents)
), start AS (
  SELECT list(struct_pack(k := k, w := w, done := CAST(0 AS BIGINT)) ORDER BY k) AS st, CAST(sum(w) AS BIGINT) AS total FROM src
), walk AS (
  SELECT CAST(-1 AS BIGINT) AS t, st, total,
         struct_pack(due := CAST(0 AS BIGINT), rel := CAST(0 AS BIGINT), k := CAST(-1 AS BIGINT), seq := CAST(0 AS BIGINT)) AS best
  FROM start
  UNION ALL
  SELECT t + 1, [struct_pack(k := x.k, w := x.w, done := CASE WHEN x.k = b.k THEN x.done + 1 ELSE x.done END) for x in st], total, b
  FROM (
    SELECT t, st, total,
      list_min([struct_pack(due := CAST(ceil((x.done + 1) * total / x.w) AS BIGINT),
                            rel := CAST(floor(x.done * total / x.w) AS BIGINT), k := x.k, seq := x.done)
                for x in st if floor(x.done * total / x.w) <= t + 1]) AS b
    FROM walk WHERE t + 1 < total
  )
), period AS (
  SELECT s.source, s.w, w.best.seq AS seq, w.t AS slot, w.total FROM walk w JOIN src s ON w.best.k = s.k
), placed AS (
  SELECT doc_id, source, CAST(coalesce(sum(coalesce(length(text), 0)) OVER (
           PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM documents
)
SELECT p.doc_id, p.source, p.place // 65536 AS block,
       ((p.place // 65536) // q.w) * q.total + q.slot AS slot, p.place
FROM placed p JOIN period q ON p.source = q.source AND (p.place // 65536) % q.w = q.seq
"""
