"""Chat formatting after collapsing cumulative snapshots.

A log that writes a conversation after every turn holds each of its prefixes as a
conversation of its own. Every turn gets a rolling hash of the turns up to it (roles,
texts and places); the hash at the last turn is the whole conversation. One whose hash is
that of a proper prefix of another goes, by an anti-join on the hash; of equal ones the
smallest ``conv_id`` stays. What remains is rendered.

Only hashes are windowed and joined, in ranges of the turns' order, so that a conversation of
a third of all turns is hashed by many tasks; texts are shuffled once, for rendering. A
rendered conversation is one value of a row and may hold as much as a row can, 2 GB. Both sides
of the anti-join are distinct before they meet, so a first turn that a third of all
conversations share is one row.

Turns are ordered by ``turn`` (null last), ties by their content; places are counted from
the order, so gaps in ``turn`` do not matter. A null role or text differs from an empty
one and is rendered as empty. Rows with a null ``conv_id`` belong to no conversation
that could be followed: each is one of a single turn. Repeated rows are turns of their
own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import stored


def two_hashes() -> list[Column]:
    """128 bits of a turn's role and text; a null differs from any text."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("b"), *reversed(parts)).alias("h2")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, is_last, p1, p2) of each turn of rows with a ``conv_id``.

    (p1, p2) combine the hashes of the turns up to ``place``, each mixed with its own place.
    The turns are dealt into ranges of their order, which split a long conversation; places
    and hashes are run up within a range, and what lies before a range is added to them.
    """
    order = [F.col("turn").asc_nulls_last(), F.col("h1"), F.col("h2")]
    narrow = turns.filter("conv_id is not null").select("conv_id", "turn", *two_hashes())
    ranged = narrow.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "turn-ranges")
    key = ["conv_id", "part"]
    # A row per conversation and range; the windows over them hold the ranges of a conversation.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*key).agg(F.count("*").alias("n"))
    sizes = sizes.select(
        *key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total")
    )
    own = Window.partitionBy(*key).orderBy(*order)
    placed = ranged.withColumn("at", F.row_number().over(own)).join(sizes, key)
    placed = placed.withColumn("place", F.col("base") + F.col("at"))
    m1, m2 = F.xxhash64("place", "h1", "h2").alias("m1"), F.xxhash64("h2", "place", "h1").alias("m2")
    placed = stored(placed.select(*key, "place", "total", m1, m2), "turn-places")
    whole = placed.groupBy(*key).agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    none = F.lit(0).cast("long")
    whole = whole.select(*key, *[F.coalesce(F.bit_xor(x).over(earlier), none).alias(x) for x in ("x1", "x2")])
    upto = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({m: F.bit_xor(m).over(upto) for m in ("m1", "m2")}).join(whole, key)
    return run.select(
        "conv_id",
        "place",
        (F.col("place") == F.col("total")).alias("is_last"),
        F.col("m1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("m2").bitwiseXOR(F.col("x2")).alias("p2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that prefix no other."""
    hashed = stored(prefix_hashes(turns), "prefix-hashes")
    key = ["place", "p1", "p2"]
    whole = hashed.filter("is_last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = hashed.filter("not is_last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def rendered() -> Column:
    """A turn as text, with the markers of a common chat format."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, chat): a rendered text per maximal conversation."""
    kept = maximal(turns)
    own = turns.select("conv_id", "turn", *two_hashes(), rendered().alias("r"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "h1", "h2", "r")))
    texts = (
        own.join(kept.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(lines, lambda x: x["r"]), "").alias("chat"))
    )
    one = F.lit(1).cast("long")
    lone = own.filter("conv_id is null").select("conv_id", one.alias("n_turns"), one.alias("n_equal"), F.col("r").alias("chat"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_equal", "chat").unionByName(lone)


#: The same in SQL, with whole contents in place of hashes.
SQL = """
with t as (
  select conv_id, turn, coalesce('1' || role, '0') || chr(1) || coalesce('1' || text, '0') || chr(2) as body,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as line
  from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls last, body) as place,
             count(*) over (partition by conv_id) as n from t),
p as (select *, string_agg(body, '') over (partition by conv_id order by place) as prefix from o),
w as (select min(conv_id) as conv_id, prefix, count(*) as n_equal from p where place = n group by prefix),
k as (select * from w where prefix not in (select prefix from p where place < n))
select k.conv_id, any_value(n)::bigint as n_turns, any_value(n_equal)::bigint as n_equal,
       string_agg(line, '' order by place) as chat
from k join o using (conv_id) group by k.conv_id
union all
select conv_id, 1::bigint, 1::bigint,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
from conversations where conv_id is null
"""
