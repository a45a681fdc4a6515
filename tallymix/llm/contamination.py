"""Benchmark decontamination by a distributed positional inverted index of the documents.

Words are runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII. A
window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window.

1. Index. Texts are cut into segments of whole documents, about ``SEGMENT`` characters each (a
   longer text is a segment of its own). A segment lists each of its terms with all places of
   the term in it, whatever the benchmark. Terms are 64-bit hashes of words; those of a segment
   that share their upper bits are packed into a row, and a header row has its documents. The
   index is a stored table, which further benchmarks can be sought in.
2. Windows. The index gives the number of postings of each test term. A window's terms are
   ordered from the rarest; one with a term that no document has is dropped.
3. Search. A window goes to the segments that have its rarest term. There the posting lists,
   each less the term's place in the window, are intersected from the rarest on, all
   candidates of a window at once. What remains after the last term is an exact phrase.
   A proximity match is a place where each word stands at most ``SLOP`` words from where
   the phrase has it, in the same document.

A segment is the unit of work. It holds its own postings only, windows stream past them, and
hot terms, passages or documents are spread over segments, so no list of the whole corpus is
ever gathered. Windows and their items are joined by window, never broadcast by hand.

Null or wordless texts have no words; null or wordless items no windows. Rows with a null or
repeated ``doc_id`` are rows of their own. Rows with an equal ``item_id`` are one item; a null
``item_id`` is the item ``null``. Other columns are ignored; empty tables give an empty result,
or one without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import Words, stored
from tallymix.llm.tokens import slices

WINDOW = 10
SLOP = 2
SEGMENT = 1 << 21


def gap_table() -> np.ndarray:
    """Which bytes stand between words, after lower-casing."""
    gap = np.ones(256, dtype=bool)
    gap[ord("0") : ord("9") + 1] = gap[ord("a") : ord("z") + 1] = gap[0x80:] = False
    return gap


GAPS = gap_table()
#: Rows that a segment's terms are packed into, by their upper bits.
BUCKET_BITS = 6
INDEX_SCHEMA = "segment bigint, bucket int, terms binary, counts binary, places binary, doc_ids array<{}>"


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment a header (``bucket`` null: first words of its documents) and rows of terms.

    ``terms`` ascend (8 bytes each), ``counts`` (4) says how many of the ``places`` (4) each has.
    """
    names = ["segment", "bucket", "terms", "counts", "places", "doc_ids"]
    segment = TaskContext.get().partitionId() << 32
    edges = np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts, SEGMENT):
            words = Words(texts[a:b], gaps=GAPS)
            order = np.argsort(words.hashes, kind="stable").astype("<u4")
            terms = words.hashes[order]
            at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            terms, counts = terms[at], np.diff(np.append(at, len(order))).astype("<u4")
            cut = [0, *np.searchsorted(terms, edges).tolist(), len(terms)]
            ends = np.append(at, len(order))
            rows = [(segment, None, None, None, words.of.astype("<u4").tobytes(), ids.slice(a, b - a).to_pylist())]
            for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                if y > x:
                    rows.append((segment, k, terms[x:y].tobytes(), counts[x:y].tobytes(), order[ends[x] : ends[y]].tobytes(), None))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(ids.type)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            segment += 1


def bucket_of(term: str) -> Column:
    """The row of a segment that a term is packed into."""
    return F.shiftrightunsigned(term, 64 - BUCKET_BITS).cast("int")


def packed_terms(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of row ``i``; terms as signed numbers in unsigned order."""
    terms, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("terms", "<u8"), ("counts", "<u4")))
    return terms, counts.astype(np.int64)


def sought_of(batch: pa.RecordBatch, i: int, terms: np.ndarray, column: str = "wanted") -> np.ndarray:
    """Where the terms of row ``i`` stand that are in its list ``column``."""
    want = np.sort(batch.column(column)[i].values.to_numpy().view(np.uint64))
    at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
    return at[terms[at] == want]


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text, ..)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(index_rows, INDEX_SCHEMA.format(id_type))
    return stored(rows, "positional-index", "zstd")


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, terms) of each window."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts, SEGMENT):
            words = Words(texts[a:b], gaps=GAPS)
            h = words.hashes.view(np.int64)
            for i in range(a, b):
                own = h[words.of[i - a] : words.of[i - a + 1]]
                if len(own):
                    size = min(WINDOW, len(own))
                    cut = np.lib.stride_tricks.sliding_window_view(own, size)
                    terms = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cut) + 1, dtype=np.int32) * size), pa.array(cut.ravel()))
                    ids = batch.column("item_id").slice(i, 1).take(pa.array(np.zeros(len(cut), np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, terms], ["item_id", "terms"])


def windows_of(benchmark: DataFrame) -> DataFrame:
    """Stored (window, terms, item_id) of ``benchmark`` (item_id, text, ..), each once."""
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    cut = benchmark.select("item_id", "text").mapInArrow(item_rows, f"item_id {id_type}, terms array<bigint>")
    named = cut.select(
        F.xxhash64("terms").alias("window"), "terms", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id")
    )
    return stored(named.distinct(), "test-windows")


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of the wanted terms of each batch of index rows."""
    for batch in batches:
        found, n = [], []
        for i in range(len(batch)):
            terms, counts = packed_terms(batch, i)
            at = sought_of(batch, i, terms)
            found.append(terms[at])
            n.append(counts[at])
        if found:
            term, of = np.unique(np.concatenate(found), return_inverse=True)
            total = np.zeros(len(term), np.int64)
            np.add.at(total, of, np.concatenate(n))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(total)], ["term", "n"])


def rarest_first(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Stored (window, terms, places): terms from the rarest in the index, with their places."""
    placed = windows.select("window", "terms").distinct()
    placed = placed.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    wanted = placed.select("term").distinct().groupBy(bucket_of("term").alias("bucket")).agg(F.collect_list("term").alias("wanted"))
    rows = index.filter("bucket is not null").select("bucket", "terms", "counts").join(wanted, "bucket")
    counts = rows.select("terms", "counts", "wanted").mapInArrow(count_rows, "term bigint, n bigint")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
    by = F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("by")  # at most WINDOW of them
    ordered = placed.join(counts, "term").groupBy("window", "length").agg(by).filter(F.size("by") == F.col("length"))
    return stored(ordered.select("window", F.col("by.term").alias("terms"), F.col("by.place").alias("places")), "rarest-first")


def picked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted terms of index rows, packed as they were, and which of them are ``first``."""
    names = ["segment", "terms", "counts", "places", "first"]
    for batch in batches:
        out = []
        for i in range(len(batch)):
            terms, counts = packed_terms(batch, i)
            at = sought_of(batch, i, terms)
            if not len(at):
                continue
            ends = np.cumsum(counts)
            places = np.frombuffer(batch.column("places")[i].as_buffer(), "<u4")
            own = [places[e - n : e] for e, n in zip(ends[at].tolist(), counts[at].tolist())]
            first = terms[sought_of(batch, i, terms, "first")].view(np.int64)
            packed = (terms[at].tobytes(), counts[at].astype("<u4").tobytes(), np.concatenate(own).tobytes())
            out.append((batch.column("segment")[i].as_py(), *packed, first))
        if out:
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def picked(index: DataFrame, ordered: DataFrame) -> DataFrame:
    """Stored postings of the terms that windows still have."""
    terms = ordered.select(F.posexplode("terms").alias("rank", "term")).groupBy("term").agg(F.min("rank").alias("rank"))
    wanted = terms.groupBy(bucket_of("term").alias("bucket")).agg(
        F.collect_list("term").alias("wanted"), F.collect_list(F.when(F.col("rank") == 0, F.col("term"))).alias("first")
    )
    rows = index.filter("bucket is not null").drop("doc_ids").join(wanted, "bucket")
    schema = "segment bigint, terms binary, counts binary, places binary, first array<bigint>"
    return stored(rows.mapInArrow(picked_rows, schema), "picked-postings", "zstd")


class Segment:
    """A segment's documents and postings, and what the windows found in it."""

    def __init__(self, number: int, first: bytes, doc_ids: pa.Array):
        self.number, self.doc_ids = number, doc_ids
        self.first = np.frombuffer(first, "<u4").astype(np.int64)
        self.lists: dict[int, np.ndarray] = {}
        self.cover = np.zeros(int(self.first[-1]) + 1, dtype=np.int32)
        self.pairs: list[tuple] = []

    def add(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray) -> None:
        ends = np.cumsum(counts).tolist()
        own = (places[a:b] for a, b in zip([0, *ends], ends))
        self.lists.update(zip(terms.view(np.int64).tolist(), own))

    def seek(self, window: int, terms: list[int], places: list[int], slop: int) -> None:
        if not all(map(self.lists.__contains__, terms)):
            return  # rarest first, so most windows end at once
        anchor = self.lists[terms[0]].astype(np.int64)
        doc = np.searchsorted(self.first, anchor, side="right") - 1
        low, high = self.first[doc], self.first[doc + 1] - 1
        start, exact = anchor - places[0], np.ones(len(anchor), dtype=bool)
        for term, place in zip(terms[1:], places[1:]):
            own, want = self.lists[term], start + place
            at = np.searchsorted(own, np.maximum(want - slop, low))
            near = own[np.minimum(at, len(own) - 1)].astype(np.int64)
            keep = (at < len(own)) & (near <= np.minimum(want + slop, high))
            hit = np.searchsorted(own, np.maximum(want, 0))
            exact &= (want >= low) & (want <= high) & (own[np.minimum(hit, len(own) - 1)] == want)
            start, exact, doc, low, high = start[keep], exact[keep], doc[keep], low[keep], high[keep]
            if not len(start):
                return
        found = start[exact]
        self.cover[found] += 1  # a window starts in a place once
        self.cover[found + len(terms)] -= 1
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        n_exact, n = np.add.reduceat(exact, cut, dtype=np.int64), np.diff(np.append(cut, len(doc)))
        # The first place: of an exact match where there is one.
        best = np.minimum.reduceat(np.where(exact, start, 1 << 40), cut)
        best = np.where(n_exact > 0, best, np.maximum(start, low)[cut])
        rows = (doc[cut], (best - low[cut]), n_exact, n)
        self.pairs.append((np.full(len(cut), window), *rows))

    def found(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)])
        n = len(self.doc_ids)
        nulls = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, self.number)), pa.array(np.arange(n)), self.doc_ids,
                pa.array(np.diff(self.first)), pa.array(np.diff(hit[self.first])), nulls, nulls, nulls, nulls,
            ],
            names,
        )
        if self.pairs:
            window, doc, first, exact, near = (np.concatenate(c) for c in zip(*self.pairs))
            nulls = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), self.number)), pa.array(doc), self.doc_ids.take(pa.array(doc)), nulls, nulls,
                    pa.array(window), pa.array(first), pa.array(exact), pa.array(near),
                ],
                names,
            )


FOUND = "segment bigint, doc bigint, doc_id {}, n_words bigint, n_hit bigint, window bigint, first_word bigint, n_exact bigint, n_near bigint"
HEADER, POSTING, SOUGHT = 0, 1, 2


def search(index: DataFrame, ordered: DataFrame, slop: int = SLOP) -> DataFrame:
    """Stored matches of the windows in the index.

    One row per document (``window`` null: its words, and those inside exact matches), and one
    per document and window found in it: the first place, and how many are exact and how many
    within ``slop``, exact ones included.
    """
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = FOUND.format(id_type)
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Segment | None = None
        for batch in batches:
            kinds, segments = batch.column("kind").to_numpy(), batch.column("segment").to_numpy()
            cut = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(segments) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == HEADER:
                    if now:
                        yield from now.found(names)
                    now = Segment(int(segments[a]), part.column("body")[0].as_py(), part.column("doc_ids")[0].values)
                elif kinds[a] == POSTING:
                    for i in range(len(part)):
                        now.add(*packed_terms(part, i), np.frombuffer(part.column("body")[i].as_py(), "<u4"))
                else:
                    for k, terms, places in zip(*(part.column(c).to_pylist() for c in ("window", "by_term", "by_place"))):
                        now.seek(k, terms, places, slop)
        if now:
            yield from now.found(names)

    columns = {
        "window": "bigint", "terms": "binary", "counts": "binary", "body": "binary", "doc_ids": f"array<{id_type}>",
        "by_term": "array<bigint>", "by_place": "array<int>",
    }

    def shaped(df: DataFrame, kind: int, **given: str) -> DataFrame:
        each = [(F.col(given[c]) if c in given else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        return df.select("segment", F.lit(kind).alias("kind"), *each)

    kept = picked(index, ordered)
    sought = kept.select("segment", F.explode("first").alias("term"))
    sought = sought.join(ordered.withColumn("term", F.col("terms")[0]), "term")
    both = shaped(index.filter("bucket is null"), HEADER, body="places", doc_ids="doc_ids")
    both = both.union(shaped(kept, POSTING, terms="terms", counts="counts", body="places"))
    both = both.union(shaped(sought, SOUGHT, window="window", by_term="terms", by_place="places"))
    both = both.repartition("segment").sortWithinPartitions("segment", "kind")
    return stored(both.mapInArrow(rows, schema), "window-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) per row of ``docs``.

    ``n_near_items`` are the items with a window found within ``slop``, exact ones included.
    """
    index, windows = build_index(docs), windows_of(benchmark)
    found = search(index, rarest_first(index, windows), slop)
    pairs = found.filter("window is not null").select("segment", "doc", "window", "n_exact")
    pairs = pairs.join(windows.select("window", "item_id"), "window").groupBy("segment", "doc", "item_id")
    pairs = pairs.agg((F.max("n_exact") > 0).alias("exact"))
    items = pairs.groupBy("segment", "doc").agg(
        F.count_if("exact").alias("n_items"),
        F.count("*").alias("n_near_items"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))), ",").alias("items"),
    )
    rows = found.filter("window is null").select("segment", "doc", "doc_id", "n_words", "n_hit")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(items, ["segment", "doc"], "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        zero("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        zero("n_near_items"),
    )


#: The same in SQL, without the index: runs of words joined as text, and the words of each
#: window sought around every place of its rarest one.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select coalesce(item_id::varchar, 'null') as item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (
  select distinct item_id, least(10, len(w)) as m, w[i : i + least(10, len(w)) - 1] as ws,
         array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
p as (
  select r, m, i, array_to_string(w[i : i + m - 1], ' ') as g
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from v))),
f as (select r, p.m, i, item_id from p join v on p.m = v.m and p.g = v.g),
h as (select r, count(distinct i + k) as n_hit from (select r, i, unnest(range(0, m)) as k from f) group by r),
t as (select r, count(distinct item_id) as n_items,
             string_agg(distinct item_id, ',' order by item_id) as items from f group by r),
dw as (select r, pos, w[pos] as word from (select r, w, unnest(range(1, len(w) + 1)) as pos from d)),
pl as (select g, m, place, ws[place] as word
       from (select g, m, ws, unnest(range(1, m + 1)) as place from (select distinct g, m, ws from v))),
an as (select * from (
         select g, m, place, pl.word, row_number() over (partition by g order by n, place) as k
         from pl join (select word, count(*) as n from dw group by word) c on c.word = pl.word) where k = 1),
ca as (select g, m, dw.r, dw.pos - an.place as start from an join dw on dw.word = an.word),
ne as (select ca.g, ca.r from ca join pl on pl.g = ca.g
       join dw on dw.r = ca.r and dw.word = pl.word and abs(dw.pos - ca.start - pl.place) <= 2
       group by ca.g, ca.r, ca.start, ca.m having count(distinct pl.place) = ca.m),
nt as (select r, count(distinct item_id) as n_near from ne join v on v.g = ne.g group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(n_near, 0)::bigint as n_near_items
from d left join h using (r) left join t using (r) left join nt using (r)
"""
