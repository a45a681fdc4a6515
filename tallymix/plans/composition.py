"""Composition of a study table: the mix per subfield and its growth over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix import schema as S
from tallymix.operators import cumulative, prep, share


def by_subfield(study: DataFrame, group: str = "synopsis", category: str = "design") -> DataFrame:
    """Count, share and total per (subfield, design), with display label.

    Shares come first and labels after, so subfields that shorten alike stay apart.
    """
    mix = share.composition(
        study, category, [group], n="n_studies", name="proportion", total="total_studies"
    )
    return prep.shorten_labels(mix, group, S.LABEL_RULES, "label")


def analyse(study: DataFrame) -> dict[str, DataFrame]:
    mix = by_subfield(study)
    totals = mix.select("synopsis", "label", "total_studies").distinct()
    order = share.group_order(mix, "synopsis", "design", S.DESIGN_LEVELS[0], "proportion")
    return {
        "composition": mix,
        "totals": totals,
        "order": order.orderBy(F.col("position")),
        "cumulative_share": cumulative.cumulative_share(study, "design", "year", S.DESIGN_LEVELS),
    }
