"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, and runs of word shapes
(length, case, marks, whether the word or pair occurred before in the text). Each indicator
is scaled by its log-count ratio between the two labels, counted over all labelled
training rows; on the scaled indicators a linear model with hinge loss is fitted by dual
coordinate descent, and its weights are interpolated with their mean size, which leans on
the ratios where the fit has seen little. Two numbers turn the margin into a probability.

Counts are one per label and bucket. A task adds up its own before they are shuffled. The fit takes about ``FIT_ROWS`` of the labelled
training rows, chosen by hash; that bound is a parameter. Everything else covers all rows.

Null and empty texts have no n-grams and get the score of the intercept. Rows with a null
label, id or text are not learned from. Without labels of both kinds, every score is the
share of label 1, or 0.5. Repeated rows get the same score; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import ODD, Words, likely_rows, mix, stored
from tallymix.llm.tokens import slices

BUCKETS = 1 << 18
FIT_ROWS = 8_000
#: Most passes over the fitted rows, and the gap of projected gradients at which they end.
EPOCHS = 1_000
GAP = 0.1
COST = 1.0
BETA = 0.5
SMOOTH = 1.0
CUT = 0.3


def class_table() -> np.ndarray:
    """Kind of each byte: 0 other, 1 lower case, 2 upper case, 3 digit, 4 mark, 5 symbol."""
    kind = np.ones(256, dtype=np.int64)
    kind[:0x80] = 5
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for c in ".,;:'\"-()?":
        kind[ord(c)] = 4
    return kind


KINDS = class_table()


def ngrams(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Sorted distinct buckets of each text."""
    words = Words(texts, lower=False)
    n, h = len(words.hashes), words.hashes
    if not n:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    kinds = KINDS[words.bytes]
    size = words.ends - words.starts
    seen = [np.add.reduceat(np.append(kinds == k, False), np.stack([words.starts, words.ends], 1).ravel())[::2] for k in range(1, 6)]
    text = np.repeat(np.arange(len(texts)), np.diff(words.of))
    pair = mix(h + np.roll(h, -1) * np.uint64(ODD))

    def earlier(x: np.ndarray) -> np.ndarray:
        """Whether the value occurred before in its text."""
        order = np.lexsort((np.arange(n), x, text))
        dup = np.concatenate([[False], (x[order][1:] == x[order][:-1]) & (text[order][1:] == text[order][:-1])])
        out = np.empty(n, dtype=bool)
        out[order] = dup
        return out

    shape = np.minimum(size, 15).astype(np.uint64)
    for k, s in enumerate(seen):
        shape = shape * np.uint64(4) + np.where(s == 0, 0, np.where(s == size, 3, np.where(s > 1, 2, 1))).astype(np.uint64)
    rough = (seen[1] == size).astype(np.uint64) * np.uint64(8) + (seen[4] > 0).astype(np.uint64) * np.uint64(4)
    rough += earlier(h).astype(np.uint64) * np.uint64(2) + earlier(pair).astype(np.uint64)
    run = [rough]
    for _ in range(4):
        run.append(run[-1] * np.uint64(16) + np.roll(rough, -len(run)))
    shape = mix(shape + np.uint64(1 << 40))
    grams = [h, pair, shape, mix(shape + np.roll(shape, -1) * np.uint64(ODD)), mix(run[2] + np.uint64(1 << 41)), mix(run[4] + np.uint64(1 << 42))]
    spans = [0, 1, 0, 1, 2, 4]
    out = []
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist()):
        parts = [g[a : max(b - s, a)] for g, s in zip(grams, spans)]
        out.append(np.unique((np.concatenate(parts) >> np.uint64(46)).astype(np.int64)))
    return out


def held_out() -> Column:
    """Rows that no label may be learned from; those with a null id are in neither part."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def packed(g: np.ndarray) -> bytes:
    """Sorted buckets as two bytes each: how many lie in each 2**16, then steps of their lower bits.

    Steps are taken modulo 2**16; those of a long text are small and compress well.
    """
    high = np.searchsorted(g, np.arange(0, BUCKETS + 1, 1 << 16))
    low = np.diff((g & 0xFFFF).astype("<u2"), prepend=np.uint16(0))
    return np.diff(high).astype("<u4").tobytes() + low.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    parts = BUCKETS >> 16
    n = np.frombuffer(raw, "<u4", parts)
    low = np.cumsum(np.frombuffer(raw, "<u2", offset=4 * parts), dtype=np.uint16)
    return (np.repeat(np.arange(parts), n) << 16) + low


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, grams) of each document; ``grams`` null where the text is."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts, 1 << 20):
            found = [None if t is None else packed(g) for t, g in zip(texts[a:b], ngrams(texts[a:b]))]
            columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "held_out", "grams"])


def with_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, grams) of ``docs`` (doc_id, text, ..), stored: all else is made of them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return stored(rows.mapInArrow(gram_rows, f"doc_id {id_type}, held_out boolean, grams binary"), "document-grams", "zstd")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per label and bucket (``grams`` null), and the chosen rows with their buckets."""
    total, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    names = ["label", "bucket", "n", "grams"]
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for label, grams in zip(labels.tolist(), batch.column("grams").to_pylist()):
            total[label, unpacked(grams)] += 1
            rows[label] += 1
        keep = batch.column("chosen")
        m = keep.true_count
        if m:
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(labels).filter(keep), none, none, batch.column("grams").filter(keep)], names)
    for label in (0, 1):
        at = np.append(np.flatnonzero(total[label]), -1)  # bucket -1: the number of rows
        counts = np.append(total[label][at[:-1]], rows[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), label, np.int32)), pa.array(at), pa.array(counts), pa.nulls(len(at), pa.binary())], names
        )


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS):
    """Hinge-loss weights of scaled indicators by dual coordinate descent; the last is the bias.

    Rows are scaled to unit length, so a long text weighs as much as a short one. An epoch
    visits every row. It ends when no row's projected gradient in an epoch differs from
    another's by more than ``GAP``, and raises if ``epochs`` do not suffice.
    """
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    x = [unit(g, ratio) for g in rows]
    q = np.array([v @ v + 1 for v in x])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        low, high = 0.0, 0.0
        for i in rng.permutation(len(rows)).tolist():
            g, v = rows[i], x[i]
            slope = y[i] * (w[g] @ v + w[-1]) - 1
            free = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == cost else slope
            low, high = min(low, free), max(high, free)
            if free:
                new = min(max(alpha[i] - slope / q[i], 0.0), cost)
                step = (new - alpha[i]) * y[i]
                w[g] += step * v
                w[-1] += step
                alpha[i] = new
        if high - low <= GAP:
            return w
    raise ValueError(f"no convergence in {epochs} epochs: gap {high - low:.3f}")


def unit(g: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[g]
    size = math.sqrt(float(v @ v))
    return v / size if size else v


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins, by Newton steps."""
    a, b = 1.0, 0.0
    hi, lo = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    t = np.where(label == 1, hi, lo)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6 * max(1.0, abs(a), abs(b)):
            return float(a), float(b)
    raise ValueError("the curve through the margins did not converge")


class Model:
    def __init__(self, weights, ratio, bias, slope, shift):
        self.weights, self.ratio, self.bias, self.slope, self.shift = weights, ratio, bias, slope, shift

    def margins(self, grams: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[g] @ unit(g, self.ratio) + self.bias for g in grams])

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(grams) + self.shift, -500, 500)))


def learn(rows: DataFrame, total: int, fit_rows: int = FIT_ROWS) -> Model:
    """The model of (doc_id, grams, label) rows, label 0 or 1, none null; about ``total`` of them."""
    share = F.lit(min(1.0, fit_rows / max(total, 1)) * (1 << 30))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share
    made = rows.select("grams", "label", chosen.alias("chosen")).mapInArrow(
        gathered, "label int, bucket bigint, n bigint, grams binary"
    )
    made = stored(made, "ngram-counts")
    table = made.filter("grams is null").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label, bucket, n = (table.column(c).to_numpy() for c in ("label", "bucket", "n"))
    counts, docs = np.zeros((2, BUCKETS)), np.zeros(2)
    body = bucket >= 0
    counts[label[body], bucket[body]] = n[body]
    docs[label[~body]] = n[~body]
    if not docs.all():
        share_1 = docs[1] / docs.sum() if docs.sum() else 0.5
        odds = math.log((share_1 + 1e-6) / (1 - share_1 + 1e-6))
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, odds)
    rate = (counts + SMOOTH) / (docs[:, None] + 2 * SMOOTH)
    ratio = np.log(rate[1] / rate[0])
    sample = made.filter("grams is not null").select("label", "grams").toArrow()
    y = sample.column("label").to_numpy().astype(np.int64)
    grams = [unpacked(g) for g in sample.column("grams").to_pylist()]
    order = np.lexsort(([len(g) for g in grams], [int(g.sum()) for g in grams], y))
    y, grams = y[order], [grams[i] for i in order]  # whatever order the rows came in
    w = descend(grams, 2.0 * y - 1, ratio)
    weights = BETA * w[:-1] + (1 - BETA) * np.abs(w[:-1]).mean()
    model = Model(weights, ratio, float(BETA * w[-1]), 1.0, 0.0)
    if len(set(y.tolist())) == 2:
        model.slope, model.shift = platt(model.margins(grams), y)
    return model


def scored(grams: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``with_grams``."""
    shared = grams.sparkSession.sparkContext.broadcast(model)
    empty = packed(np.zeros(0, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores([unpacked(g or empty) for g in batch.column("grams").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    id_type = grams.schema["doc_id"].dataType.simpleString()
    rated = grams.mapInArrow(rows, f"doc_id {id_type}, held_out boolean, score double")
    return rated.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Scores of ``docs`` by a model of the ``labels`` (doc_id, quality) outside the held-out part.

    Texts become packed n-grams once. Only those of documents that may have a label (by a
    bitmap of fixed size) are shuffled to the labels, by one kind of join at every size.
    """
    grams = with_grams(docs)
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    known = known.filter(~held_out()).dropDuplicates()
    rows = grams.filter("grams is not null and not held_out").select("doc_id", "grams")
    rows = likely_rows(rows, known.select("doc_id")).hint("merge").join(known, "doc_id")
    return scored(grams, learn(rows, known.count(), fit_rows))
