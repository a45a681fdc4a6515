"""Mixing sources to target weights with hash-threshold histograms.

Every row has a hash; a source's budget becomes a threshold, and the rows below it are
taken. Words are summed by source and leading hash bits, the bucket in which a budget ends
is found, and only the rows of that bucket are summed again by the next bits, until it
holds one hash. Nothing is sorted. A larger budget has a larger threshold, so the mixes
of smaller budgets are subsets of it. A budget of more than the whole source takes every
row that many times whole and the rest by the threshold.

Nulls: a null text has size 0; a null source is a source of its own, last in the order; a
null ``doc_id`` hashes like any other value, together with the text. Rows repeated in both
have one hash and are taken together. A row that spans the end of a budget is taken if more than half of it fits. A
source without words has target 0. Copies of clashing columns are not made: only ``size``,
``source_size``, ``target`` and ``copies`` are added, in place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash, and bits that one histogram resolves.
BITS, STEP = 60, 12


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash() -> Column:
    """Of id and text: texts that share a null or repeated id are still apart."""
    body = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    digest = F.md5(body)
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words per source, from (source, source_size), one row per source.

    Weights repeat over the sources in code-point order. Shares are filled up like water:
    sources are capped in ascending order of cap by weight until the next is not above its cap;
    the level rises up to there and falls after it.
    The windows hold one row per source, not per document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    caps = caps.withColumn("level", level)
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    caps = caps.withColumn("level", F.max(fits).over(everything))
    return caps.select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def thresholds(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, whole, bound, at_bound) per source of (source, size, hash).

    A row is taken ``whole`` times, and once more if its hash is below ``bound``, or equal
    to it where ``at_bound``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn(
        "whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    )
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = stored(plan.withColumns({"lead": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}), "mix")
    narrow = rows.filter("size > 0").select(F.col("source").alias("of"), "size", "hash")
    for known in range(0, BITS, STEP):
        inside = narrow.join(
            state, F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("hash", BITS - known) == F.col("lead"))
        )
        bins = inside.groupBy(*state.columns, F.shiftright("hash", BITS - known - STEP).alias("bin")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("end", F.col("before") + F.sum("words").over(upto))
        # The first bucket whose end is past the budget; sources hold at most 2**STEP buckets.
        edge = bins.filter("end > rest").groupBy("source").agg(
            F.min_by(F.struct("bin", F.expr("end - words").alias("start"), "words", "low", "high"), "bin").alias("e")
        )
        edge = edge.select(F.col("source").alias("of"), "e.*")
        state = state.join(edge, F.col("of").eqNullSafe(F.col("source")), "left").select(
            *plan.columns,
            F.coalesce("bin", F.lit(0).cast("long")).alias("lead"),
            F.coalesce("start", F.lit(0).cast("long")).alias("before"),
            "words",
            "low",
            "high",
        )
        state = stored(state, "mix")
        if state.filter("low < high").isEmpty():
            break
        state = state.drop("words", "low", "high")
    # A source without words has no bucket; its bound takes nothing.
    return state.select(
        "source",
        "source_size",
        "target",
        "whole",
        F.coalesce("low", F.lit(0).cast("long")).alias("bound"),
        F.coalesce(F.col("rest") - F.col("before") > F.col("words") / 2, F.lit(False)).alias("at_bound"),
    )


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, hash, ..) with source_size, target and copies."""
    plan = plan.withColumnRenamed("source", "of")
    more = (F.col("hash") < F.col("bound")) | ((F.col("hash") == F.col("bound")) & F.col("at_bound"))
    return (
        rows.join(plan, F.col("of").eqNullSafe(F.col("source")))
        .withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0))
        .drop("of", "whole", "bound", "at_bound")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source, ..) with size, source_size, target and copies."""
    docs = docs.drop("size", "hash", "source_size", "target", "copies", "of", "whole", "bound", "at_bound")
    sized = docs.withColumns({"size": words_of(), "hash": row_hash()})
    narrow = stored(sized.select("source", "size", "hash"), "mix-rows")
    return take(sized, thresholds(narrow, weights, most)).drop("hash")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; the text is read once."""
    rows = docs.select("doc_id", "source", words_of().alias("size"), row_hash().alias("hash"))
    rows = stored(rows, "mix-rows")
    return take(rows, thresholds(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL = """
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || coalesce(text, '')), 1, 15))::bigint as hash
  from documents),
w as (select source, sum(size)::bigint as source_size,
             [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
      from s group by source),
c as (select *, 3 * source_size as cap,
             row_number() over (order by 3 * source_size / weight, source nulls last) as k from w),
l as (select a.k, (select sum(source_size) from c) as total,
             coalesce(sum(b.cap) filter (b.k < a.k), 0) as capped, sum(b.weight) filter (b.k >= a.k) as open
      from c a, c b group by a.k),
v as (select max((total - capped)::double / open) filter (cap >= (total - capped)::double / open * weight) as level
      from l join c using (k)),
t as (select source, source_size, least(cap::double, level * weight) as target from c, v),
r as (select s.doc_id, s.size, s.hash, t.*, floor(target / nullif(source_size, 0))::bigint as whole
      from s join t on s.source is not distinct from t.source),
g as (select source, hash, sum(size) as words from s group by all),
e as (select source, hash, words, sum(words) over (partition by source order by hash) as upto from g)
select r.doc_id, r.size, r.source_size, r.target,
       (r.size * (coalesce(whole, 0)
         + case when upto - words < target - whole * source_size
                 and (upto <= target - whole * source_size
                      or target - whole * source_size - (upto - words) > words / 2) then 1 else 0 end))::bigint as taken
from r join e on r.source is not distinct from e.source and r.hash = e.hash
"""
