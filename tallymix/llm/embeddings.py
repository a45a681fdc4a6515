"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Vectors link if their cosine, in double precision, is at least ``0.9``.

1. Equal vectors are one group; only one vector of each group is hashed.
2. A table of the index turns a unit vector by three rounds of random signs and a fast
   Hadamard transform, twice, and takes the vertex of the cross-polytope (the coordinate
   largest in size, with its sign) nearest to each result. The two vertices are its bucket.
3. A vector lies in one bucket of a table and probes ``PROBES`` more: those reached by
   putting the next best vertex in place of the best in one or both halves, cheapest first.
4. Pairs of a bucket (one lies in it, the other lies in it or probes it) are verified by
   their cosine. A pair that meets in several buckets counts in the smallest one only, which
   both vectors' bucket lists tell, so no pairs are shuffled to be made distinct. A bucket
   gives each vector its number of links and one edge to the lowest id it is connected with
   there, which together span the bucket's components; pairs are never written out. Buckets
   above ``BLOCK`` rows are cut into blocks of pairs.

Nothing is capped: every vector is in every table. What the index can miss is a pair that
meets in no table; measured recall is in the README.

Null vectors, zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths neither. Rows with a null ``vec_id`` count as vectors of their
own; a component's id is its smallest non-null id. Repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import components, mix, stored

COSINE = 0.9
TABLES = 8
PROBES = 3
BLOCK = 1_000


def signs(table: int, half: int, turn: int, dims: int) -> np.ndarray:
    """+1 or -1 for each coordinate, the same in every process."""
    seed = np.uint64(((table * 2 + half) * 3 + turn) << 32)
    return np.where(mix(np.arange(1, dims + 1, dtype=np.uint64) + seed) >> np.uint64(63), 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def vertices(x: np.ndarray, table: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second vertex of each row after the rotation, and what the second loses."""
    for turn in range(3):
        x = hadamard(x * signs(table, half, turn, x.shape[1]))
    size, rows = np.abs(x), np.arange(len(x))
    best = size.argmax(axis=1)
    top = size[rows, best].copy()
    size[rows, best] = -1
    second = size.argmax(axis=1)
    code = lambda at: at * 2 + (x[rows, at] < 0)
    return code(best), code(second), top - size[rows, second]


def buckets(x: np.ndarray) -> np.ndarray:
    """[row, table, 1 + PROBES] bucket numbers; the first of a table is the row's own."""
    n, d = x.shape
    wide = 1 << max(int(d - 1).bit_length(), 1)
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.int64)
    for t in range(TABLES):
        a, a2, la = vertices(x, t, 0)
        b, b2, lb = vertices(x, t, 1)
        near = np.where(la <= lb, a2 * 2 * wide + b, a * 2 * wide + b2)
        far = np.where(la <= lb, a * 2 * wide + b2, a2 * 2 * wide + b)
        out[:, t] = np.stack([a * 2 * wide + b, near, far, a2 * 2 * wide + b2], axis=1)[:, : 1 + PROBES]
    return out


def hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, unit, codes) of each vector, grouped by length to form matrices."""
    for batch in batches:
        for start in range(0, len(batch), 2_000):
            part = batch.slice(start, 2_000)
            groups = part.column("group").to_numpy()
            vectors = part.column("embedding").to_pylist()
            lengths = np.array([len(v) for v in vectors])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = np.array([vectors[i] for i in at], dtype=np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay finite
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                codes = buckets(x).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups[at]),
                        pa.array(np.full(len(at), d)),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array(list(codes), pa.list_(pa.int64())),
                    ],
                    ["group", "dims", "unit", "codes"],
                )


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the smallest (table, bucket) in which each pair of rows meets."""
    own_a, own_b = a[:, :, :1], b[:, :, :1]
    none = np.iinfo(np.int64).max
    hit = np.minimum(
        np.where((own_a == b).any(axis=2), own_a[:, :, 0], none),
        np.where((own_b == a).any(axis=2), own_b[:, :, 0], none),
    )
    table = (hit < none).argmax(axis=1)
    return table, hit[np.arange(len(hit)), table]


def merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of each pair; ``root`` holds the lowest member of each one's tree."""
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, links, neighbour) of each group with links in a block.

    ``neighbour`` is the lowest group of its component within the block.
    """

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        d = rows["dims"][0].as_py()
        unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(-1, d)
        codes = np.stack(rows["codes"].to_numpy()).reshape(len(unit), TABLES, -1)
        group, size, own, part = (rows[c].to_numpy(zero_copy_only=False) for c in ("group", "size", "own", "part"))
        table, bucket, i, j = (rows[c][0].as_py() for c in ("table", "bucket", "i", "j"))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links, order = np.zeros(len(unit), np.int64), group.argsort()
        root, place = np.arange(len(unit)), order.argsort()
        for s in range(0, len(left), 500):
            a = left[s : s + 500]
            x, y = np.nonzero(unit[a] @ unit[right].T >= COSINE - 1e-9)
            x, y = a[x], right[y]
            keep = (own[x] | own[y]) & ((x < y) if i == j else True)
            x, y = x[keep], y[keep]
            keep = (unit[x] * unit[y]).sum(axis=1) >= COSINE
            x, y = x[keep], y[keep]
            if len(x):
                first, code = met(codes[x], codes[y])
                keep = (first == table) & (code == bucket)
                x, y = x[keep], y[keep]
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
                merge(root, place[x], place[y])
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at]), pa.array(links[at]), pa.array(group[order[root[place[at]]]])],
                ["group", "links", "neighbour"],
            )

    kept, last, key_columns = [], None, ("dims", "table", "bucket", "i", "j")
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in key_columns], axis=1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
            if end == start:
                continue
            if kept and keys[start].tolist() != last:
                if sum(map(len, kept)) > 1:
                    yield from block(pa.Table.from_batches(kept))
                kept = []
            last = keys[start].tolist()
            kept.append(batch.slice(start, end - start))
    if sum(map(len, kept)) > 1:
        yield from block(pa.Table.from_batches(kept))


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of (vec_id, embedding, ..)."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # -0.0 and 0.0 are one value; the hash only spreads groups, equality decides.
    sound = rows.filter("usable").withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    groups = sound.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    groups = groups.withColumn("group", F.monotonically_increasing_id())
    groups = stored(groups, "vector-groups")

    coded = groups.select("group", "embedding").mapInArrow(
        hashed_rows, "group bigint, dims bigint, unit binary, codes array<bigint>"
    )
    coded = stored(coded.join(groups.select("group", "size"), "group"), "vector-codes")
    spread = coded.select("*", F.posexplode("codes").alias("at", "bucket"))
    spread = spread.withColumns(
        {"table": F.floor(F.col("at") / (1 + PROBES)), "own": F.col("at") % (1 + PROBES) == 0}
    )
    place = ["dims", "table", "bucket"]
    held = spread.groupBy(*place).agg(F.count("*").alias("rows"), F.max("own").alias("any_own"))
    held = held.filter("rows > 1 and any_own").select(*place, F.ceil(F.col("rows") / BLOCK).alias("parts"))
    spread = spread.join(held, place)
    spread = spread.withColumn("part", F.pmod(F.xxhash64("group"), "parts"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = spread.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    spread = spread.select(*place, "i", "j", "part", "group", "size", "own", "unit", "codes")
    found = spread.repartition(*place, "i", "j").sortWithinPartitions(*place, "i", "j")
    found = stored(found.mapInArrow(pair_rows, "group bigint, links bigint, neighbour bigint"), "vector-links")

    links = found.groupBy("group").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("group").alias("a"), F.col("neighbour").alias("b"))
    own = groups.select(F.col("group").alias("a"), F.col("group").alias("b"))
    comp = components(edges.union(own)).withColumnRenamed("node", "group")
    whole = groups.join(comp, "group").join(links, "group", "left")
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    whole = whole.join(least, "component").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        "component_id",
    )
    linked = sound.join(whole, "embedding").select("vec_id", "n_links", "component_id")
    lone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
