"""Study, indicator, income and draws tables read off the driver's test tables.

The two raw sources keep the traits the cleaning is for: text numbers with bad values,
raw design labels, missing places, different column names and order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix import schema as S
from tallymix.functions.sizing import materialise
from tallymix.operators import linkage, prep, reshape
from tallymix.sources.tables import read_table

YEARS = list(range(1995, 2002))
YEAR_COLUMNS = [f"X{y}" for y in YEARS]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SYNOPSES = [*SEGMENTS, S.SECOND_SOURCE_SYNOPSIS]
CONTINENTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NAME_OVERRIDES = {"NATION_3": "N03", "NA": None}

# Raw design labels: main source by (priority, status), second source by priority.
MAIN_LABELS = [
    ("1-URGENT", "F", "After"),
    ("1-URGENT", "O", "Before-After"),
    ("2-HIGH", "F", "BACI"),
    ("2-HIGH", "O", "R-BACI"),
    ("3-MEDIUM", "F", "Paired BACI"),
    ("3-MEDIUM", "O", "Paired R-BACI"),
    ("4-NOT SPECIFIED", "F", "Control-Impact"),
    ("4-NOT SPECIFIED", "O", "Paired Control-Impact"),
    ("5-LOW", "F", "RCT"),
    ("5-LOW", "O", "Paired RCT"),
]
SECOND_LABELS = [
    ("1-URGENT", "After"),
    ("2-HIGH", "Before-After"),
    ("3-MEDIUM", "Control-Impact"),
    ("4-NOT SPECIFIED", "BACI"),
    ("5-LOW", "RCT"),
]

# Columns the driver's tables are read with.
ORDERS = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
CUSTOMER = "c_custkey long, c_nationkey int, c_mktsegment string"
NATION = "n_nationkey int, n_name string, n_regionkey int"
REGION = "r_regionkey int, r_name string"
LINEITEM = "l_orderkey long, l_discount double, l_tax double, l_extendedprice double"
PART = "p_partkey long, p_name string, p_brand string, p_type string"
EVENTS = "ts timestamp_ntz, user_id long, event_type string, value double"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet", globals()[name.upper()])


def placed_orders(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


# Text fields of the raw sources, and their columns under both sources' names.
YEAR_TEXT = "CASE WHEN o_totalprice < 6000 THEN 'unknown' ELSE CAST(year(o_orderdate) AS STRING) END"
LAT_TEXT = (
    "CASE WHEN o_totalprice > 490000 THEN 'NA' ELSE "
    "CAST(CAST((o_orderkey * 37) % 18000 AS DOUBLE) / 100 - 90 AS STRING) END"
)
LONG_TEXT = "CAST(CAST((o_orderkey * 71) % 36000 AS DOUBLE) / 100 - 180 AS STRING)"
COUNTRY = "nullif(n_name, 'NATION_7')"
CONTINENT = "CASE WHEN n_name <> 'NATION_13' THEN r_name END"


def main_source(spark: SparkSession, d: str, placed: DataFrame | None = None) -> DataFrame:
    placed = placed if placed is not None else placed_orders(spark, d)
    label = " ".join(
        f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{t}'" for p, s, t in MAIN_LABELS
    )
    return placed.filter("o_orderstatus <> 'P'").selectExpr(
        "o_custkey AS study_id",
        "c_mktsegment AS synopsis",
        f"CASE {label} END AS design_raw",
        f"{YEAR_TEXT} AS year_raw",
        f"{CONTINENT} AS continent",
        f"{COUNTRY} AS country",
        f"{LAT_TEXT} AS lat_raw",
        f"{LONG_TEXT} AS long_raw",
    )


def second_source(spark: SparkSession, d: str, placed: DataFrame | None = None) -> DataFrame:
    placed = placed if placed is not None else placed_orders(spark, d)
    label = " ".join(f"WHEN o_orderpriority = '{p}' THEN '{t}'" for p, t in SECOND_LABELS)
    return placed.filter("o_orderstatus = 'P'").selectExpr(
        "o_custkey AS paper_id",
        f"{YEAR_TEXT} AS Year",
        f"CASE {label} END AS Study_design",
        f"{LONG_TEXT} AS Long",
        f"{LAT_TEXT} AS Lat",
        f"{COUNTRY} AS Country",
        f"{CONTINENT} AS Continent",
    )


def clean_main(spark: SparkSession, d: str, placed: DataFrame | None = None) -> DataFrame:
    names = {
        "study_id": "study_id",
        "synopsis": "synopsis",
        "year": "year_raw",
        "design": "design_raw",
        "continent": "continent",
        "country": "country",
        "lat": "lat_raw",
        "long": "long_raw",
    }
    return prep.clean_source(main_source(spark, d, placed), names, S.DESIGN_RECODE_MAIN, S.DESIGN_LEVELS)


def clean_second(spark: SparkSession, d: str, placed: DataFrame | None = None) -> DataFrame:
    names = {
        "study_id": "paper_id",
        "year": "Year",
        "design": "Study_design",
        "continent": "Continent",
        "country": "Country",
        "lat": "Lat",
        "long": "Long",
    }
    return prep.clean_source(
        second_source(spark, d, placed),
        names,
        S.DESIGN_RECODE_SECOND,
        S.DESIGN_LEVELS,
        {"synopsis": S.SECOND_SOURCE_SYNOPSIS},
    )


def study(spark: SparkSession, d: str) -> DataFrame:
    """The central table: both sources, cleaned and stacked by name."""
    placed = placed_orders(spark, d)
    return prep.append_by_name(clean_main(spark, d, placed), clean_second(spark, d, placed))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("key"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
    )


def _cells(rows: DataFrame, spark: SparkSession, d: str, **measures) -> DataFrame:
    """Measures per nation and year."""
    return (
        rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("y"))
        .agg(*[m.alias(k) for k, m in measures.items()])
    )


def _wide(cells: DataFrame, spark: SparkSession, d: str, measure: str) -> DataFrame:
    wide = cells.groupBy("c_nationkey").pivot("y", YEARS).agg(F.first(measure))
    return (
        wide.withColumnsRenamed({str(y): f"X{y}" for y in YEARS})
        .join(nations(spark, d), F.col("c_nationkey") == F.col("key"))
        .select("name", "code", *YEAR_COLUMNS)
    )


def rd_wide(spark: SparkSession, d: str) -> DataFrame:
    """First indicator: mean order price in units of 100,000; one empty cell."""
    cells = _cells(table(spark, d, "orders"), spark, d, rd=F.avg("o_totalprice") / 100000)
    wide = _wide(cells, spark, d, "rd")
    return wide.withColumn("X1996", F.when(F.col("code") != "N05", F.col("X1996")))


def line_cells(spark: SparkSession, d: str) -> DataFrame:
    """The line measures of both other indicators, stored: one pass over the lines."""
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return materialise(
        _cells(
            lines,
            spark,
            d,
            gdp=F.sqrt(F.avg("l_extendedprice")),
            ge=F.sqrt(F.avg("l_tax")) * 10 - 2,
        )
    )


def gdp_wide(spark: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    """Second indicator: root of the mean line price."""
    return _wide(cells, spark, d, "gdp")


def ge_wide(spark: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    """Third indicator: root of the mean line tax, rescaled."""
    return _wide(cells, spark, d, "ge")


def indicator_long(wide: DataFrame, values_to: str) -> DataFrame:
    return reshape.lengthen_years(wide, ["name", "code"], YEAR_COLUMNS, values_to, "X")


def rd_gdp(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    """The first two indicators, joined on (code, year)."""
    cells = cells if cells is not None else line_cells(spark, d)
    rd = indicator_long(rd_wide(spark, d), "rd_percent")
    gdp = indicator_long(gdp_wide(spark, d, cells), "gdp_pc").select("code", "year", "gdp_pc")
    return linkage.join_indicators(rd, gdp, ["code", "year"])


def rd_expenditure(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    return linkage.derived_indicator(rd_gdp(spark, d, cells), "rd_percent", "gdp_pc", "rd_pc")


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """The (country, year) dimension; the third indicator joins on (name, year)."""
    cells = line_cells(spark, d)
    ge = indicator_long(ge_wide(spark, d, cells), "ge").select("name", "year", "ge")
    rd = rd_expenditure(spark, d, cells).select("name", "code", "year", "rd_pc")
    return linkage.join_indicators(rd, ge, ["name", "year"])


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Patterns for most nations: one is left to the overrides, one to nobody."""
    n = nations(spark, d).filter(~F.col("name").isin("NATION_3", "NATION_21"))
    return n.select(
        F.concat(F.lit("(?i)^nation[_ ]"), F.regexp_replace("name", "NATION_", ""), F.lit("$")).alias(
            "pattern"
        ),
        F.col("code").alias("iso3c"),
        F.col("key").alias("priority"),
    )


def coded_study(spark: SparkSession, d: str) -> DataFrame:
    """Study rows with a standard country code."""
    return linkage.standardise_names(
        study(spark, d), "country", crosswalk(spark, d), NAME_OVERRIDES, "iso3c"
    )


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Study rows with the indicators of their country and year."""
    dim = indicators(spark, d).select(F.col("code").alias("iso3c"), "year", "rd_pc", "ge")
    return linkage.attach(coded_study(spark, d), dim, ["iso3c", "year"])


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Complete rows with both indicators standardised; the joined rows are stored once."""
    full = materialise(prep.complete_rows(merged(spark, d), ["rd_pc", "ge"]))
    return linkage.standardise(full, ["rd_pc", "ge"])


def income_wide(spark: SparkSession, d: str) -> DataFrame:
    """Income classes per nation and year; one nation has none."""
    classes = F.array(*[F.lit(x) for x in ("H", "UM", "LM", "L")])
    cols = [
        F.when(F.col("key") != 11, F.get(classes, (F.col("key") + y) % 4)).alias(str(y)) for y in YEARS
    ]
    return nations(spark, d).select(F.col("code").alias("iso3c"), "name", *cols)


def income_long(spark: SparkSession, d: str) -> DataFrame:
    wide = income_wide(spark, d)
    years = [c for c in wide.columns if c not in ("iso3c", "name")]
    return reshape.lengthen_years(wide, ["iso3c", "name"], years, "income_category")


def with_income(spark: SparkSession, d: str) -> DataFrame:
    """Study rows of the years with income data, with class and group."""
    rows = prep.value_range(coded_study(spark, d), "year", YEARS[0], YEARS[-1])
    dim = income_long(spark, d).select("iso3c", "year", "income_category")
    return linkage.class_group(
        linkage.attach(rows, dim, ["iso3c", "year"]), "income_category", S.INCOME_GROUPS, "income_group"
    )


def grouped_income(spark: SparkSession, d: str) -> DataFrame:
    return prep.complete_rows(with_income(spark, d), ["income_group"])


def located(spark: SparkSession, d: str) -> DataFrame:
    """Study rows that have coordinates and a continent."""
    return prep.complete_rows(study(spark, d), ["lat", "long", "continent"])


def draws_like(spark: SparkSession, d: str) -> DataFrame:
    """A draws-shaped reading of the events."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("draw"),
        F.dayofmonth("ts").alias("synopsis"),
        F.col("event_type").alias("design"),
        F.col("value").alias("epred"),
    )
