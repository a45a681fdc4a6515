"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces of at most ``LENGTH`` tokens; only longer documents are cut. There
are at most ``LENGTH`` different lengths, so the instance is the histogram of lengths: it is
all that reaches the driver, whatever the number of documents. On it

1. Reduction fixes sets that provably dominate every other set holding their largest
   piece: a piece nothing fits beside; the largest partner where only one more piece can
   fit; the partner that fills the sequence exactly; the largest partner where at most two
   more can fit and no two are longer together than it. Each rule is applied to all
   pieces of a length at once, and the rest is a smaller instance.
2. Best-fit decreasing packs the remainder, again a run of equal pieces at a time.

The result is a list of runs of equally filled sequences. A piece finds its run by its
length and its rank among the pieces of that length; ranks come from counts per (length,
salt) and a row number within, so pieces of one length, however many, are spread out.

Null or empty text is a document of its end id alone. Repeated rows are packed each for
itself. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import stored
from tallymix.llm.tokens import Encoder

LENGTH = 2048
END = 0
SALTS = 1024


class Lengths:
    """Counts by length, with the lengths present in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: int(v) for k, v in counts.items() if v > 0}
        self.present = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.present.remove(length)

    def below(self, limit: int) -> int | None:
        """Largest length present up to ``limit``."""
        i = bisect_right(self.present, limit)
        return self.present[i - 1] if i else None

    def smallest(self, n: int) -> int:
        """Sum of the n shortest pieces; infinite if there are fewer."""
        total = 0
        for length in self.present:
            k = min(n, self.counts[length])
            total, n = total + k * length, n - k
            if not n:
                return total
        return 1 << 60

    def best_two(self, limit: int) -> int:
        """Largest sum of two pieces up to ``limit``; 0 if no two fit."""
        best, i, j = 0, 0, bisect_right(self.present, limit) - 1
        while i <= j:
            a, b = self.present[i], self.present[j]
            if a + b > limit or (i == j and self.counts[a] < 2):
                j -= 1
            else:
                best, i = max(best, a + b), i + 1
        return best


def reduction(lengths: Lengths, room: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, take their pieces out, and return them as (lengths, times)."""
    fixed = []
    for length in reversed(list(lengths.present)):
        while length in lengths.counts:
            n, rest = lengths.counts[length], room - length
            lengths.take(length, 1)  # what stands beside one piece of this length
            partner, one, two, three = (lengths.below(rest), *map(lengths.smallest, (1, 2, 3)))
            dominates = partner is not None and (
                partner == rest or two > rest or (three > rest and partner >= lengths.best_two(rest))
            )
            lengths.counts[length] = n
            if n == 1:
                insort(lengths.present, length)
            if one > rest:
                fixed.append(((length,), n))
                lengths.take(length, n)
            elif dominates and partner == length:
                fixed.append(((length, length), n // 2))
                lengths.take(length, n // 2 * 2)
            elif dominates:
                # Fewer pieces of either length leave the rule's conditions true.
                n = min(n, lengths.counts[partner])
                fixed.append(((length, partner), n))
                lengths.take(length, n)
                lengths.take(partner, n)
            else:
                break
    return fixed


def best_fit(lengths: Lengths, room: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths, times) of the sequences."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = room - sum(pattern)
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for length in reversed(lengths.present):
        n = lengths.counts[length]
        while n:
            i = bisect_right(gaps, length - 1)
            if i == len(gaps):  # no open sequence has room: fill new ones with this length
                each = room // length
                for many in {each: n // each, n % each: 1} .items() if n % each else [(each, n // each)]:
                    if many[0] and many[1]:
                        put((length,) * many[0], many[1])
                break
            runs = open_[gaps[i]]
            pattern, m = runs.pop()
            k = min(m, n)
            if m > k:
                runs.append((pattern, m - k))
            if not runs:
                del open_[gaps[i]]
                gaps.pop(i)
            put(pattern + (length,), k)
            n -= k
    return [run for gap in sorted(open_) for run in open_[gap]]


def packing_plan(counts: dict[int, int], room: int = LENGTH) -> dict[str, np.ndarray]:
    """Slots sorted by ``key`` (length and first rank): first sequence and offset of each."""
    lengths = Lengths(counts)
    runs = reduction(lengths, room) + best_fit(lengths, room)
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, n in runs:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            slots.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 4)
    return {
        "key": (table[:, 0] << 48) + table[:, 1],
        "rank": table[:, 1],
        "sequence": table[:, 2],
        "offset": table[:, 3],
        "sequences": np.array([sequence]),
    }


def cut(n: int, room: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; a shorter piece comes first."""
    first = n % room or room
    return [(0, first)] + [(s, room) for s in range(first, n, room)]


def pieces(docs: DataFrame, path: str, room: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the documents' token ids."""
    last = np.array([end], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path, True)
        for batch in batches:
            out, at = [], []
            for i, text in enumerate(batch.column("text")):
                raw = encoder.encode(text.as_py()) + last
                for k, (start, n) in enumerate(cut(len(raw) // 4, room)):
                    out.append((k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])))
                    at.append(i)
            table = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(table[:, 0].astype(np.int32)),
                    *(pa.array(table[:, c]) for c in (1, 2, 3)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(docs: DataFrame, path: str, room: int = LENGTH) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text, ..) with sequence_id and offset."""
    # The salt is a row number, stored with the row: equal rows are spread as well.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    cut_up = stored(pieces(docs, path, room).select("*", salt), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, room)

    sums = cut_up.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = cut_up.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = np.searchsorted(plan["key"], (length << 48) + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(plan["sequence"][slot] + rank - plan["rank"][slot]),
                    pa.array(plan["offset"][slot]),
                ],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str) -> DataFrame:
    """(sequence_id, ids) of a packing: the token ids in place, for a trainer.

    ``doc_id`` must be unique here. Ids are made again rather than kept beside the plan.
    """
    last = np.array([END], dtype="<u4")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path, True)
        for batch in batches:
            made = [np.append(np.frombuffer(encoder.encode(t.as_py()), "<u4"), last) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m.astype(np.int64) for m in made], pa.list_(pa.int64()))],
                ["doc_id", "ids"],
            )

    whole = docs.select("doc_id", "text").mapInArrow(ids, "doc_id bigint, ids array<bigint>")
    own = packed.join(whole, "doc_id").select(
        "sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )
    return own.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
