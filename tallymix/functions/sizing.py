"""Stored intermediates and null-safe joins."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallymix.session import ensure_checkpoints, shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute and cut the lineage with partitions and their order as they are."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the cluster's shared folder."""
    return written(df, "rows")


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute once: written to the cluster's shared folder and read again.

    An eager checkpoint computes its rows twice, and keeps the size estimate of the plan it
    came from. What is read here has the size of its files, so loops over joins keep plans
    and their estimates small.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates of the rows taken while they are written: no job more."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys appear once.

    ``keys`` are names, or (left name, right name) pairs. Fan-out on duplicate right
    keys is kept.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    hidden = {r: f"__right_{i}" for i, (_, r) in enumerate(pairs)}
    right = right.withColumnsRenamed(hidden)
    on = reduce(
        lambda a, b: a & b, [F.col(l).eqNullSafe(F.col(hidden[r])) for l, r in pairs]
    )
    joined = left.join(right, on, how)
    return joined.drop(*hidden.values()) if how not in ("left_semi", "left_anti") else joined
