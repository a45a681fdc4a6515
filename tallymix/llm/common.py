"""Stored intermediates, connected components and word hashes for the operators here."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Compute once: written to the cluster's shared folder and read again.

    Whatever executor is lost afterwards, the rows need not be computed anew.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the broadcast bitmap of document ids: at most 2**19 rows of 32 bits.
BITMAP = 1 << 24


def likely_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``doc_id`` may be among ``ids``: all of those and few others.

    A bitmap of a fixed number of hashed ids is broadcast; its size has no part in the data's.
    With more ids than bits it lets every row pass, and the join after it does all the work.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    word, bit = F.floor(slot / 32).alias("word"), F.expr("1L").alias("one")
    marks = ids.select(word, F.call_function("shiftleft", bit, (slot % 32).cast("int")).alias("mark"))
    marks = marks.groupBy("word").agg(F.bit_or("mark").alias("marks"))
    held = rows.withColumn("word", word).join(F.broadcast(marks), "word")
    is_set = F.call_function("shiftright", F.col("marks"), (slot % 32).cast("int")).bitwiseAND(F.lit(1)) == 1
    return held.filter(is_set).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node.

    ``component`` is the smallest node reachable. Large-star and small-star steps
    alternate until the edges stop changing; each is a partial minimum per node and one
    equi-join, so a node with many neighbours is folded map-side and its join can be split.
    A self-loop gives its node a row.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, before = stored(edges.distinct(), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).union(loops).distinct()
    roots = roots.join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte, the same in every process.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(
        np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, dtype=np.uint64)])
    )


class Words:
    """Words of several texts, cut at ASCII white space or other ``gaps``, as 64-bit hashes.

    A word's hash is a polynomial in its bytes, taken as a difference of running sums, so
    that no word is handled by itself. ``of[i]:of[i + 1]`` are the words of text ``i``;
    ``starts`` and ``ends`` are byte offsets into the joined texts. The sums are made for
    pieces of about ``PIECE`` bytes that end between words, so that long texts need little
    more memory than their bytes and hashes.
    """

    PIECE = 1 << 19
    _up = _powers(ODD, 2 * PIECE)
    _down = _powers(pow(ODD, -1, 1 << 64), 2 * PIECE)

    def __init__(self, texts: Sequence[str | None], lower: bool = True, gaps: np.ndarray = SPACE):
        raws = [t.encode() if t else b"" for t in texts]
        joined = b"\n".join([*raws, b""])
        self.bytes = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        made, a = [], 0
        while a < len(self.bytes):
            b = self.cut(a + Words.PIECE, gaps)
            made.append(self.piece(a, b, gaps))
            a = b
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.starts, self.ends, self.hashes = (np.concatenate(c) for c in zip(*made)) if made else none
        at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        self.of = np.searchsorted(self.starts, at)

    def cut(self, at: int, gaps: np.ndarray) -> int:
        """The first gap from ``at`` on, or the end."""
        step = 256
        while at < len(self.bytes):
            hit = np.flatnonzero(gaps[self.bytes[at : at + step]])
            if len(hit):
                return at + int(hit[0])
            at, step = at + step, 2 * step
        return len(self.bytes)

    def piece(self, a: int, b: int, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.bytes[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gaps[own], [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        n = len(own) + 1
        up, down = Words._up, Words._down
        if n > len(up):  # a word longer than a piece
            up, down = _powers(ODD, n), _powers(pow(ODD, -1, 1 << 64), n)
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[own] * up[: n - 1], out=total[1:])
        return starts + a, ends + a, mix((total[ends] - total[starts]) * down[starts])


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words.

    A text of fewer words has its whole sequence as one; a text without words none.
    """
    h = words.hashes
    rolled = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    factor = [np.uint64(pow(ODD, 2 * k + 1, 1 << 64)) for k in range(width)]
    for k in range(width):
        rolled += h[k : k + len(rolled)] * factor[k]
    rolled, out = mix(rolled), []
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            part = h[a:b] * np.array(factor[: b - a], dtype=np.uint64)
            out.append(mix(np.array([part.sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
