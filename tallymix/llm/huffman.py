"""Token ids in files of canonical, length-limited Huffman codes.

Format of a file (a folder readable by any Spark reader)
- ``codebook``: one row per id that occurs, with its code length. Codes are canonical:
  ascending by (length, id), so lengths are all a reader needs.
- ``blocks``: self-contained blocks, in order of (part, first). A block holds whole
  documents: their ids, their numbers of tokens, the code bits, most significant first,
  and the bit offset of every ``STRIDE``-th token. Those checkpoints let a reader start
  anywhere and decode the stretches between them side by side.

Encoding
1. Documents are range-partitioned by ``doc_id`` and a row number, so that a hot id is spread
   too, tokenized once, and the ids stored.
2. Global counts come from the stored ids; there is a count per vocabulary entry, so code
   lengths are made on the driver (package-merge, at most ``MAX_BITS``).
3. Blocks are encoded where the stored ids lie.

Decoding looks ``MAX_BITS`` bits up in one table, for all stretches of a batch at once.

Null text is empty: a document of its end id alone. Null ``doc_id`` come first; repeated
rows are documents of their own, side by side. Other columns are ignored. An empty table
makes an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymix.llm.common import fresh_path
from tallymix.llm.tokens import WordIds, slices

END = 1
MAX_BITS = 18
STRIDE = 512
BLOCK_TOKENS = 1 << 16
#: Blocks that are decoded together.
BLOCKS_AT_ONCE = 8


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Code lengths of least total, none above ``most``, by package-merge.

    A symbol's length is the number of levels at which it is among the chosen items.
    """
    n = len(counts)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} symbols need codes longer than {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(most):
        items = np.concatenate([leaves, packages])
        at = np.argsort(items, kind="stable")
        levels.append(at < n)
        items = items[at][: len(items) // 2 * 2]
        packages = items[0::2] + items[1::2]
    lengths, wanted = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(levels):
        chosen = int(leaf[:wanted].sum())
        lengths[:chosen] += 1
        wanted = 2 * (wanted - chosen)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ids with given lengths, and the decoding table."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.bits = int(lengths.max()) if len(ids) else 1
        widths = np.left_shift(1, self.bits - lengths)
        starts = np.cumsum(widths) - widths
        self.code = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64)
        self.length = np.zeros(len(self.code), dtype=np.int64)
        self.code[ids] = starts >> (self.bits - lengths)
        self.length[ids] = lengths
        self.symbols = np.zeros(1 << self.bits, dtype=np.uint32)
        self.widths = np.ones(1 << self.bits, dtype=np.int64)
        filled = int(widths.sum())
        self.symbols[:filled] = np.repeat(ids, widths)
        self.widths[:filled] = np.repeat(lengths, widths)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code bits, and the bit offset of every ``STRIDE``-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        n = self.length[ids]
        at = np.cumsum(n) - n
        word, spare = at >> 6, 64 - (at & 63) - n
        code = self.code[ids]
        here = np.where(
            spare >= 0,
            code << np.maximum(spare, 0).astype(np.uint64),
            code >> np.maximum(-spare, 0).astype(np.uint64),
        )
        words = np.zeros(int(at[-1] + n[-1]) // 64 + 2, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(spare < 0)  # at most one a word, and the first bits of the next
        words[word[over] + 1] |= code[over] << (64 + spare[over]).astype(np.uint64)
        size = (int(at[-1] + n[-1]) + 7) // 8
        return words.astype(">u8").tobytes()[:size], at[::STRIDE]

    def decode(self, bits: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of stretches of ``counts`` ids from bit ``offsets``; all advance together."""
        raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")  # those that end first come last
        at, left = offsets[order].astype(np.int64), counts[order]
        out = np.zeros((len(at), STRIDE), dtype=np.uint32)
        shift = np.uint32(32 - self.bits)
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k))
            pos = at[:live]
            look = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> shift
            out[:live, k] = self.symbols[look]
            at[:live] += self.widths[look]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back].ravel()[(np.arange(STRIDE) < counts[:, None]).ravel()]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(part, place, doc_id, ids) in ascending order of doc_id; ids as 16- or 32-bit bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.get(path)
        kind = np.dtype("<u2" if words.encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 1 << 20):
                ids, n = words.encode(texts[a:b])
                ends = np.cumsum(n + 1)
                made = np.full(int(ends[-1]), END, kind)
                body = np.ones(len(made), dtype=bool)
                body[ends - 1] = False
                made[body] = ids
                offsets = np.concatenate([[0], ends * kind.itemsize]).astype(np.int32)
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, part, np.int64)),
                        pa.array(np.arange(place, place + m)),
                        batch.column("doc_id").slice(a, m),
                        pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(made)]),
                        pa.array(np.full(m, kind.itemsize, np.int32)),
                    ],
                    ["part", "place", "doc_id", "ids", "width"],
                )
                place += m

    # A row number beside the id: rows of one hot id are spread over ranges too.
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ordered.select("doc_id", "text").mapInArrow(
        rows, f"part bigint, place bigint, doc_id {id_type}, ids binary, width int"
    )


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    kinds = {2: "<u2", 4: "<u4"}
    return [np.frombuffer(i, kinds[w]) for i, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]


def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        ids = _ids(batch)
        for a in range(0, len(ids), 1000):
            own = np.bincount(np.concatenate(ids[a : a + 1000]))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode ``docs`` (doc_id, text, ..) into the files of ``path``."""
    spark = docs.sparkSession
    kept = fresh_path(spark, "token-ids")
    tokenized(docs, tokenizer).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.parquet(kept)
    counts = ids.select("ids", "width").mapInArrow(id_counts, "id bigint, n bigint")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per vocabulary entry
    symbols = np.array(sorted((r["id"], r["n"]) for r in counts), dtype=np.int64).reshape(-1, 2)
    lengths = code_lengths(symbols[:, 1]) if len(symbols) else np.zeros(0, np.int64)
    code = spark.sparkContext.broadcast((symbols[:, 0], lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Code(*code.value)

        def block(held: list[tuple]) -> tuple:
            bits, offsets = made.encode(np.concatenate([h[3] for h in held]))
            return (
                held[0][0],
                held[0][1],
                [h[2] for h in held],
                np.array([len(h[3]) for h in held], "<u4").tobytes(),
                offsets.astype("<u4").tobytes() if len(bits) < 1 << 29 else offsets.astype("<u8").tobytes(),
                bits,
            )

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "first", "doc_ids", "n_tokens", "offsets", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        held, size = [], 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id")), _ids(batch))
            for row in rows:
                follows = held and row[0] == held[-1][0] and row[1] == held[-1][1] + 1
                if held and (size >= BLOCK_TOKENS or not follows):
                    yield batch_of([block(held)])
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield batch_of([block(held)])

    schema = "part bigint, first bigint, doc_ids array<bigint>, n_tokens binary, offsets binary, bits binary"
    ids.mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    book = [(int(i), int(n)) for i, n in zip(symbols[:, 0], lengths)]
    spark.createDataFrame(book, "id bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")


def decoded(code: Code, blocks: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    """The documents of some blocks, whose stretches are decoded side by side."""
    columns = {c: blocks.column(c).to_pylist() for c in ("part", "first", "n_tokens", "offsets", "bits")}
    sizes, starts, counts, base = [], [], [], 0
    for n, offsets, bits in zip(columns["n_tokens"], columns["offsets"], columns["bits"]):
        sizes.append(np.frombuffer(n, "<u4").astype(np.int64))
        starts.append(np.frombuffer(offsets, "<u4" if len(bits) < 1 << 29 else "<u8").astype(np.int64) + 8 * base)
        total = int(sizes[-1].sum())
        counts.append(np.minimum(STRIDE, total - STRIDE * np.arange(len(starts[-1]))))
        base += len(bits)
    ids = code.decode(b"".join(columns["bits"]), np.concatenate(starts), np.concatenate(counts)).astype("<u4")
    n = np.concatenate(sizes)
    raw, ends = memoryview(ids).cast("B"), np.cumsum(n)
    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist())]
    docs = [len(s) for s in sizes]
    place = np.concatenate([f + np.arange(m) for f, m in zip(columns["first"], docs)])
    out = [
        pa.array(np.repeat(np.array(columns["part"], dtype=np.int64), docs)),
        pa.array(place.astype(np.int64)),
        blocks.column("doc_ids").flatten(),
        pa.array(n),
        pa.array(crc, pa.int64()),
    ]
    names = ["part", "place", "doc_id", "n_tokens", "ids_crc32"]
    if with_ids:
        edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        out, names = [*out, pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int64)))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(out, names)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, place, doc_id, n_tokens, ids_crc32, ids) of the documents in the files."""
    book = sorted((r["id"], r["length"]) for r in spark.read.parquet(f"{path}/codebook").collect())
    book = spark.sparkContext.broadcast(np.array(book, dtype=np.int64).reshape(-1, 2))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(book.value[:, 0], book.value[:, 1])
        for batch in batches:
            for a in range(0, len(batch), BLOCKS_AT_ONCE):
                yield decoded(code, batch.slice(a, BLOCKS_AT_ONCE), with_ids)

    schema = "part bigint, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks.select("part", "first", "doc_ids", "n_tokens", "offsets", "bits")
    return blocks.mapInArrow(rows, schema + (", ids array<bigint>" if with_ids else ""))


def with_starts(decoded: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ``start`` counts the ids of all documents before."""
    # One row per part; the window below it runs within a part.
    sums = decoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    return (
        decoded.withColumn("within", within)
        .join(sums, "part")
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )
