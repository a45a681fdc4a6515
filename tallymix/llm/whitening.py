"""Embedding whitening by Chebyshev-filtered subspace iteration.

An entry c, as double, is the integer ``x = floor(1024 c) + 100000``. The leading
eigenvectors of the covariance V of all vectors are found without forming V:

1. One pass sums the integers exactly; a second sums the squares about the mean (the trace).
2. A block Q of ``BLOCK`` columns per wanted component is filtered: a Chebyshev polynomial of
   V, small on the unwanted spectrum [a, b] and steep above it, is applied by its three-term
   recurrence. A step needs one distributed pass, which sums Xc' (Xc Q) over blocks of rows,
   Xc being the centred integers. b is the smallest Ritz value of the block; a is a bound
   from a few Lanczos steps with one vector (were it too high, the filter would only be weaker).
3. The block is made orthonormal by QR, and a Rayleigh-Ritz step on Q' V Q gives values and
   vectors. The product V Q it needs is the first step of the next filter as well.
4. This goes on until each wanted pair is certified: the residual ``|V q - e q|`` is at most
   ``CERTIFIED`` times the largest value and repeated steps lower it no more, or it is at the
   level of rounding. A block that cannot be certified raises.

Only sums of the size of the block (vector length x columns) reach the driver; a row is read
from stored blocks in each pass. The degree of a filter is held so low that rounding along the
largest value cannot drown the smallest wanted one.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of
another length than the commonest (ties: the longest) have no place in its space and are
dropped like them. An entry whose x would leave 2**53 is held there. Equal rows count as often
as they occur; a null ``vec_id`` is an id like any other. There are at most as many components
as entries. A component without variance has a null ``whitened`` and ``explained`` 0, and no
part in ``identity_error``; a deviation beyond 64 bits is null. Other columns are ignored; a
table without usable vectors gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import stored

COMPONENTS = 8
#: Columns of the iterated block per wanted component.
BLOCK = 4
DEGREE = 10
#: Steps that look for the lower end of the spectrum.
LANCZOS = 8
#: Largest growth of the first direction over the last in one filter.
SPREAD = 1e6
#: Certified residual, and residual at rounding level, as shares of the largest eigenvalue.
CERTIFIED, ROUNDING = 1e-12, 1e-14
MOST_PASSES = 600
#: Bytes of the integers in a stored block of rows.
BLOCK_BYTES = 1 << 20
LOW_BITS = 26
BOUND = 2.0**53


def block_rows(d: int) -> Callable:
    """Rows (ids, body): integers of several vectors, 64 bits each, row after row."""
    most = max(1, BLOCK_BYTES // (8 * d))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                c = part.column("embedding").flatten().to_numpy().reshape(len(part), d)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(c * 1024), -BOUND, BOUND).astype(np.int64) + 100_000
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype("<i8").tobytes()], pa.binary())], ["ids", "body"])

    return rows


def integers(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for body in batch.column("body"):
            yield np.frombuffer(body.as_buffer(), "<i8").reshape(-1, d)


def summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple, kind: str, d: int) -> np.ndarray:
    """The sum of ``part`` (a matrix of ``shape``) over all blocks of rows.

    Each task adds up its blocks; the partial matrices are summed row by row by a shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64 if kind == "bigint" else np.float64)
        for x in integers(batches, d):
            total += part(x)
        lists = pa.array(list(total), pa.list_(pa.int64() if kind == "bigint" else pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), lists], ["i", "v"])

    made = blocks.select("body").mapInArrow(rows, f"i int, v array<{kind}>")
    made = made.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(shape[1])]).alias("v"))
    out = np.zeros(shape, dtype=np.int64 if kind == "bigint" else np.float64)
    for r in made.collect():  # as many rows as the matrix has, whatever the table's size
        out[r["i"]] = r["v"]
    return out


def chebyshev_growth(t: float, degree: int) -> float:
    """Size of the Chebyshev polynomial of a degree at t >= 1."""
    return math.cosh(min(degree * math.acosh(max(t, 1.0)), 700.0))


def filter_degree(first: float, last: float, a: float, b: float) -> int:
    """The highest degree that keeps the growth at ``first`` within SPREAD of that at ``last``."""
    at = lambda e: (2 * e - a - b) / (b - a)
    for degree in range(DEGREE, 1, -1):
        if chebyshev_growth(at(first), degree) <= SPREAD * chebyshev_growth(at(last), degree):
            return degree
    return 1


def lowest_value(product: Callable[[np.ndarray], np.ndarray], d: int, steps: int = LANCZOS) -> float:
    """About the smallest eigenvalue of V, from below: a Ritz value less its residual, at least 0."""
    q = np.zeros((d, 0))
    v = np.random.default_rng(1).normal(size=d)
    diagonal, off = [], []
    for _ in range(min(steps, d)):
        q = np.column_stack([q, v / np.linalg.norm(v)])
        v = product(q[:, -1:])[:, 0]
        diagonal.append(float(q[:, -1] @ v))
        for _ in range(2):  # stay orthogonal to what there is
            v = v - q @ (q.T @ v)
        off.append(float(np.linalg.norm(v)))
        if off[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
    value, vector = np.linalg.eigh(np.diag(diagonal) + np.diag(off[:-1], 1) + np.diag(off[:-1], -1))
    return max(float(value[0]) - off[-1] * abs(float(vector[-1, 0])), 0.0)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the ``wanted`` largest eigenvalues of V, given V Q."""
    m = min(d, BLOCK * wanted)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, m)))[0]
    best, stalls, passes = math.inf, 0, LANCZOS
    lowest = lowest_value(product, d) if m < d else 0.0
    while True:
        vq = product(q)
        passes += 1
        h = q.T @ vq
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq - q * value, axis=0)[:wanted]
        top, worst = max(value[0], 0.0), float(residual.max())
        stalls = stalls + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if m == d or worst <= ROUNDING * top or (worst <= CERTIFIED * top and stalls >= 2):
            return value[:wanted], q[:, :wanted], residual
        if passes > MOST_PASSES:
            raise ValueError(f"not certified: residual {worst / top:.1e} of the largest eigenvalue after {passes} passes")
        b = float(value[-1])
        if b <= 1e-14 * top:  # the block spans the whole range of V; one more product cleans it
            q = np.linalg.qr(np.where(np.linalg.norm(vq, axis=0) > 1e-13 * top, vq, q))[0]
            continue
        # T_1, T_2, .. of (2 V - a - b) / (b - a), each scaled like the columns it acts on.
        a = min(lowest, 0.95 * b)
        mapped = lambda vx, x: (2 * vx - (a + b) * x) / (b - a)
        before, now = q, mapped(vq, q)
        for _ in range(filter_degree(value[0], value[wanted - 1], a, b) - 1):
            before, now = now, 2 * mapped(product(now), now) - before
            passes += 1
            size = np.linalg.norm(now, axis=0)
            before, now = before / size, now / size
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 over the entries of each row; None beyond 64 bits."""
    widest = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if x.shape[1] * widest**2 < 1 << 63:
        t = n * x - np.array(total, dtype=np.int64)
        return (t * t).sum(axis=1).tolist()
    if widest < 1 << 62:
        t = n * x - np.array(total, dtype=np.int64)
        if x.shape[1] * int(np.abs(t).max(initial=0)) ** 2 < 1 << 63:
            return (t * t).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual).

    One row per usable row of ``rows`` (vec_id, embedding, ..) and component; ``residual`` is
    that of the component's certificate, as a share of the largest eigenvalue.
    """
    spark, id_type = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {SCHEMA}"
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count()
    commonest = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    d, n = int(commonest["d"]), int(commonest["count"])
    blocks = rows.filter(F.size("embedding") == d).mapInArrow(block_rows(d), f"ids array<{id_type}>, body binary")
    blocks = stored(blocks, "vector-blocks")

    low = (1 << LOW_BITS) - 1
    halves = summed(blocks, lambda x: np.stack([(x & low).sum(axis=0), (x >> LOW_BITS).sum(axis=0)], axis=1), (d, 2), "bigint", d)
    total = [int(a) + (int(b) << LOW_BITS) for a, b in halves]
    mean = np.array([s / n for s in total])
    trace = float(summed(blocks, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], (d, 1), "double", d).sum()) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return summed(blocks, part, q.shape, "double", d) / n

    k = min(components, d)
    value, vector, residual = leading_pairs(product, d, k)
    varies = value > 1e-12 * max(trace, 0.0)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, value, 1.0)), 0.0)
    turn = vector * scale

    means = summed(blocks, lambda x: ((x - mean) @ turn).sum(axis=0)[None], (1, k), "double", d)[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - means
        return w.T @ w

    gap = (summed(blocks, spread, (k, k), "double", d) / n - np.eye(k))[np.ix_(varies, varies)]
    error = float(np.abs(gap).max(initial=0.0))
    explained = np.where(varies, value / trace if trace > 0 else 0.0, 0.0)
    share = residual / value[0] if value[0] > 0 else np.zeros(k)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("ids")[i].values
                x = np.frombuffer(batch.column("body")[i].as_buffer(), "<i8").reshape(-1, d)
                w, m = (x - mean) @ turn, len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(deviations(x, n, total), pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel(), mask=np.tile(~varies, m)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                        pa.array(np.tile(share, m)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return blocks.mapInArrow(final, schema)
