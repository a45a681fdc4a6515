"""Declared schemas and the fixed vocabularies of the study analyses."""

from __future__ import annotations

from pyspark.sql import types as T

# The central table every analysis starts from.
STUDY = T.StructType(
    [
        T.StructField("study_id", T.LongType()),
        T.StructField("synopsis", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("design", T.StringType()),
        T.StructField("continent", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
    ]
)


def indicator_schema(years, prefix="X"):
    """Wide indicator file: name, code, then one double column per year."""
    fields = [T.StructField("name", T.StringType()), T.StructField("code", T.StringType())]
    fields += [T.StructField(f"{prefix}{y}", T.DoubleType()) for y in years]
    return T.StructType(fields)


def income_schema(years):
    """Wide income-class file: iso3c, name, then one text column per year."""
    fields = [T.StructField("iso3c", T.StringType()), T.StructField("name", T.StringType())]
    fields += [T.StructField(str(y), T.StringType()) for y in years]
    return T.StructType(fields)


# The ordered design levels.
DESIGN_LEVELS = ["After", "BA", "CI", "BACI", "Rand.exp."]

# Design labels of the main source -> design level.
DESIGN_RECODE_MAIN = {
    "After": "After",
    "Before-After": "BA",
    "BACI": "BACI",
    "R-BACI": "Rand.exp.",
    "Paired BACI": "BACI",
    "Paired R-BACI": "Rand.exp.",
    "Control-Impact": "CI",
    "Paired Control-Impact": "CI",
    "RCT": "Rand.exp.",
    "Paired RCT": "Rand.exp.",
}

# Design labels of the second source -> design level.
DESIGN_RECODE_SECOND = {
    "After": "After",
    "Before-After": "BA",
    "Control-Impact": "CI",
    "BACI": "BACI",
    "RCT": "Rand.exp.",
}

# Fixed value: the subfield given to the second source.
SECOND_SOURCE_SYNOPSIS = "Non-English language"

# Label shortening, applied in this order.
LABEL_RULES = [
    (" Conservation.*", ""),
    ("Management of ", ""),
    (" and ", " & "),
    ("Freshwater", "FW"),
    ("Invasive Species", "Inv.Sp."),
    ("Biodiversity of ", ""),
    ("Invertebrate", "Invert."),
    ("Mediterranean", "Med."),
    ("Artificial", "Art."),
    ("Non-English ", "NE-"),
    ("Sustainable ", "Sust."),
]

# Country names the pattern crosswalk leaves unmatched.
NAME_OVERRIDES = {
    "China, P.R.": "CHN",
    "The Netherlands": "NLD",
    "Trinidad & Tobago": "TTO",
    "Czech Republic": "CZE",
    "Cote dIvoire": "CIV",
    "CÙte d?Ivoire": "CIV",
    "C?te d?Ivoire": "CIV",
    "NA": None,
}

# Income class -> income group.
INCOME_GROUPS = {
    "H": "High income",
    "L": "Low/Middle income",
    "LM": "Low/Middle income",
    "UM": "Low/Middle income",
}
