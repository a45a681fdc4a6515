"""Cluster bootstrap: all rows of a cluster move together within a draw."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallymix.functions.sizing import written
from tallymix.models.design import Design
from tallymix.models.fit import PRIOR_SD, fit_groups

HASH_RANGE = 1 << 32
DRAWS_PER_HASH = 4
# Weights that a task makes at once, and sums that it holds.
TILE_WEIGHTS = 1 << 22
HELD_SUMS = 1 << 24


def poisson_edges() -> list[int]:
    """Upper 32-bit hash edges of Poisson(1) counts 0, 1, 2, ..."""
    edges, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1.0) / math.factorial(k)
        edge = int(total * HASH_RANGE)
        if edges and edge <= edges[-1]:
            return edges
        edges.append(edge)
        k += 1


def hash_prefix(cluster: Column, name: str | None = None) -> Column:
    """What the hashes of a cluster begin with; the number of a block follows.

    ``name`` sets apart the weights of several cluster columns.
    """
    parts = [F.coalesce(cluster.cast("string"), F.lit("\\N")), F.lit("|")]
    return F.concat(*([F.lit(f"{name}|")] if name else []), *parts)


def block_hash(cluster: Column, block: Column, name: str | None = None) -> Column:
    """Hash of a cluster and a block of four draws: 32 hexadecimal digits, 8 per draw."""
    return F.md5(F.concat(hash_prefix(cluster, name), block.cast("string")))


def poisson_weight(h: Column) -> Column:
    """Poisson(1) count of a uniform hash, by inverse distribution function.

    The hash stays text: eight hexadecimal digits order like the number they spell.
    """
    edges = poisson_edges()
    out = F.when(h < f"{edges[0]:08x}", F.lit(0))
    for k, edge in enumerate(edges[1:], start=1):
        out = out.when(h < f"{edge:08x}", F.lit(k))
    return out.otherwise(F.lit(len(edges)))


def cluster_weights(prefixes: Sequence[bytes], draws: int) -> np.ndarray:
    """``poisson_weight`` of ``block_hash``, clusters x draws, from the prefixes of the clusters."""
    blocks = [str(b).encode() for b in range(-(-draws // DRAWS_PER_HASH))]
    digests = b"".join([md5(p + b).digest() for p in prefixes for b in blocks])
    h = np.frombuffer(digests, dtype=">u4").astype("uint32").reshape(len(prefixes), -1)[:, :draws]
    out = np.zeros(h.shape, dtype="int8")
    for edge in poisson_edges():
        out += h >= np.uint32(edge)
    return out.astype("int64")


def weighted_cells(batches: Iterable[pa.RecordBatch], keys: Sequence[str], clusters: Sequence[str], draws: int):
    """Batches of (draw, keys, sum of weight x ``__c``) from rows in the order of their clusters.

    A cluster is hashed once in a run of its rows; a row then adds its cluster's weights in
    all draws to those of its cell. Cells are held up to a fixed number of sums, then handed on.
    """
    most = max(1, HELD_SUMS // draws)
    tile = min(most, max(1, TILE_WEIGHTS // draws))
    places: dict[tuple, int] = {}
    sums = np.zeros((most, draws), dtype="int64")
    kinds: list[pa.DataType] = []

    def handed_on():
        cells = [pa.array(v, type=t) for v, t in zip(zip(*places), kinds)]
        some = max(1, TILE_WEIGHTS // 16 // draws)
        for at in range(0, len(places), some):
            cell, draw = np.nonzero(sums[at : min(at + some, len(places))])
            columns = [c.take(pa.array(cell + at)) for c in cells]
            arrays = [pa.array((draw + 1).astype("int32")), *columns, pa.array(sums[cell + at, draw])]
            yield pa.RecordBatch.from_arrays(arrays, names=["draw", *keys, "__n"])
        sums[: len(places)] = 0
        places.clear()

    for batch in batches:
        kinds = [batch.schema.field(k).type for k in keys]
        for at in range(0, batch.num_rows, tile):
            if len(places) > most - tile:
                yield from handed_on()
            now = batch.slice(at, tile)
            of = list(zip(*[now.column(c).to_pylist() for c in clusters]))
            units = {u: i for i, u in enumerate(dict.fromkeys(of))}
            weights = np.ones((len(units), draws), dtype="int64")
            for each in zip(*units):
                own = {p: i for i, p in enumerate(dict.fromkeys(each))}
                weights *= cluster_weights(list(own), draws)[[own[p] for p in each]]
            for cell, u, c in zip(zip(*[now.column(k).to_pylist() for k in keys]), of, now.column("__c").to_pylist()):
                w = weights[units[u]]
                sums[places.setdefault(cell, len(places))] += w if c == 1 else w * c
    yield from handed_on()


def bootstrap_cells(
    df: DataFrame, cluster: str | Sequence[str], keys: Sequence[str], draws: int, n: str = "n"
) -> DataFrame:
    """Weighted counts per (draw, keys).

    With several cluster columns (nested or crossed, such as country and study) a row has a
    weight per column and counts with their product, so that rows which share any of them
    move together. A column name is part of its hash: equal values of two columns are
    unrelated. A NULL is a cluster of its own.

    The rows are collapsed to (cluster, keys) once and stored. Ranges of them, equal in rows
    even where a cluster is hot, then go to tasks that hash a cluster once, not once per cell
    of it, and sum all draws of a cell at a time: what is shuffled after it, and returned, is
    bounded by draws x cells.
    """
    spark = df.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    clusters = [cluster] if isinstance(cluster, str) else list(cluster)
    names = [None] if len(clusters) == 1 else clusters
    held = [f"__cluster_{i}" for i in range(len(clusters))]
    # A single cluster may be one of the keys as well.
    base = df.select(*keys, *[hash_prefix(F.col(c), m).cast("binary").alias(h) for c, m, h in zip(clusters, names, held)])
    base = written(base.groupBy(*held, *keys).agg(F.count("*").alias("__c")), "cluster-cells")
    ranges = base.repartitionByRange(tasks, *held, *keys).sortWithinPartitions(*held)
    fields = [StructField("draw", IntegerType()), *base.select(*keys).schema.fields, StructField("__n", LongType())]

    def weighted(batches):
        return weighted_cells(batches, keys, held, draws)

    parts = ranges.mapInArrow(weighted, StructType(fields))
    return parts.groupBy("draw", *keys).agg(F.sum("__n").alias(n)).filter(F.col(n) > 0)


def multinomial_draws(
    df: DataFrame,
    cluster: str | Sequence[str],
    design: Design,
    draws: int = 200,
    prior_sd: float | None = PRIOR_SD,
) -> DataFrame:
    """Coefficients per draw, as contrasts to the base category: (draw, category, term, estimate).

    Bootstrap estimates, not a posterior. The cluster is one column (study) or several, whose
    weights multiply (country and study). The weighted cells are stored once: counting and fitting read the same table.
    """
    keys = [*design.covariates, design.category]
    cells = written(bootstrap_cells(design.check(df), cluster, keys, draws), "draw-cells")
    return fit_groups(cells, "draw", draws, design, "n", prior_sd)
