"""The multinomial fit as an estimator and a model that is kept and read back."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.models import predict
from tallymix.models.design import Design
from tallymix.models.fit import COEFFICIENT_SCHEMA, PRIOR_SD, multinomial_fit
from tallymix.sources.tables import read_table


class Multinomial(Estimator):
    """Fits a design on cells: rows of covariates, category and their count ``n``."""

    def __init__(self, design: Design, prior_sd: float | None = PRIOR_SD, n: str = "n"):
        super().__init__()
        self.design, self.prior_sd, self.n = design, prior_sd, n

    def _fit(self, cells: DataFrame) -> MultinomialModel:
        return MultinomialModel(self.design, multinomial_fit(cells, self.design, self.n, self.prior_sd))


class MultinomialModel(Model, MLWritable, MLReadable):
    """Coefficients of a design, as contrasts to its first category.

    ``transform`` adds the probability of every category to rows of covariates, as an array
    in the order of the levels. A level that the design does not list raises.
    """

    def __init__(self, design: Design, coefficients: DataFrame):
        super().__init__()
        self.design, self.coefficients = design, coefficients

    def _transform(self, grid: DataFrame) -> DataFrame:
        packed = predict.pack_draws(self.coefficients.withColumn("draw", F.lit(1)), self.design)
        rows = grid.withColumn("__coef", packed.select("__coef").scalar())
        scored = predict.with_probabilities(rows, self.design)
        return scored.select(*grid.columns, F.array(*predict.probabilities(self.design)).alias("probability"))

    def write(self) -> MultinomialWriter:
        return MultinomialWriter(self)

    @classmethod
    def read(cls) -> MultinomialReader:
        return MultinomialReader()


class MultinomialWriter(MLWriter):
    """The design as a line of JSON beside the coefficients as Parquet."""

    def __init__(self, model: MultinomialModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        d, mode = self.model.design, "overwrite" if self.shouldOverwrite else "error"
        form = {"category": d.category, "levels": list(d.levels), "numeric": list(d.numeric), "factors": {f: list(v) for f, v in d.factors.items()}}
        self.model.coefficients.write.mode(mode).parquet(f"{path}/coefficients")
        line = self.sparkSession.createDataFrame([(json.dumps(form),)], "value string")
        line.coalesce(1).write.mode(mode).text(f"{path}/design")


class MultinomialReader(MLReader):
    def load(self, path: str) -> MultinomialModel:
        spark = SparkSession.active()
        form = json.loads(spark.read.text(f"{path}/design").first()[0])
        return MultinomialModel(Design(**form), read_table(spark, f"{path}/coefficients", COEFFICIENT_SCHEMA))
