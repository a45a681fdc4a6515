"""From raw documents to packed sequences: five stages, each by one operator.

Every stage works on all rows that the one before it kept, and all but the last return
the columns of ``documents``. Columns beside those a stage needs are set aside under
other names while it runs, so whatever their names, they come out as they went in.
Null texts leave in the first stage, which can tell no language for them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.llm import jaccard, language, mixing, packing, quality_rules
from tallymix.llm.common import stored, table

#: A document goes if no language has this share of its letters.
LANGUAGE_SHARE = 0.4
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def set_aside(docs: DataFrame, needed: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with all columns but the needed ones renamed, and then named back."""
    hidden = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = work(docs.withColumnsRenamed(hidden))
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; mixed and wordless ones go."""
    model = language.learn(language.training(docs))

    def keep(rows: DataFrame) -> DataFrame:
        found = language.identified(rows, model, ("__lang", "__share", "__spans"))
        return found.filter((F.col("__lang") != language.UND) & (F.col("__share") >= LANGUAGE_SHARE))

    return set_aside(docs, ["text"], keep)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the floor and are more likely good than not."""
    return set_aside(docs, ["text"], lambda rows: quality_rules.filtered(rows, stored))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, repeated rows included.

    Rows are told apart by ``doc_id`` where it is a key; where it is null or repeated, by a
    number of their own, for which the rows are stored once more.
    """

    def keep(rows: DataFrame) -> DataFrame:
        unclear = rows.groupBy("doc_id").count().filter("doc_id is null or count > 1")
        if unclear.isEmpty():
            rows = rows.withColumn("__row", F.col("doc_id"))
        else:
            rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        groups = jaccard.near_copies(rows.select(F.col("__row").alias("doc_id"), "text"))
        first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("__row"))
        return rows.join(first, "__row", "left_semi")

    return set_aside(docs, ["doc_id", "text"], keep)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""

    def keep(rows: DataFrame) -> DataFrame:
        mixed = mixing.mixed(rows).filter("copies > 0")
        return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    return set_aside(docs, ["doc_id", "text", "source"], keep)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Language models and near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
