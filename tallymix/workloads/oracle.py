"""DuckDB SQL for the queries of ``catalogue``, written independently of the operators."""

from __future__ import annotations

#: The years of the test tables, and the draws and folds of the queries.
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
DRAWS, MANY_DRAWS, FOLDS = 50, 4000, 5
#: 2**32 times the distribution function of Poisson(1) at 0, 1, 2, ..
EDGES = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292, 4294967295]


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def replication_views(levels: list[str]) -> dict[str, str]:
    """Rows of a subfield drawn anew, category by category, by summing binomial probabilities."""
    out = {
        "boot_p": """
        SELECT draw, synopsis, design, n / sum(n) OVER (PARTITION BY draw, synopsis) AS p FROM boot_syn""",
        "rep_left_0": """
        SELECT draw, synopsis, rows_seen AS n_left, 1.0::DOUBLE AS rest
        FROM (SELECT DISTINCT draw, synopsis FROM boot_syn)
        JOIN (SELECT synopsis, count(*) AS rows_seen FROM study GROUP BY ALL) USING (synopsis)""",
    }
    for i, level in enumerate(levels[:-1]):
        out[f"rep_share_{i}"] = f"""
        SELECT l.*, coalesce(p, 0) AS p, least(greatest(coalesce(p / rest, 0), 0), 1) AS s,
               (CAST('0x' || substr(md5('check|' || l.draw || '|' || l.synopsis || '|{i}'), 1, 8) AS BIGINT) + 0.5)
               / 4294967296.0 AS u
        FROM rep_left_{i} l LEFT JOIN boot_p b
          ON b.draw = l.draw AND b.synopsis = l.synopsis AND b.design = '{level}'"""
        out[f"rep_sum_{i}"] = f"""
        SELECT *, sum(exp(lgamma(n_left + 1) - lgamma(k + 1) - lgamma(n_left - k + 1) + k * ln(s)
                          + (n_left - k) * ln(1 - s))) OVER (PARTITION BY draw, synopsis ORDER BY k) AS f
        FROM (SELECT *, unnest(range(0, n_left + 1)) AS k FROM rep_share_{i} WHERE s > 0 AND s < 1)"""
        out[f"rep_{i}"] = f"""
        SELECT q.*, CASE WHEN s <= 0 THEN 0 WHEN s >= 1 THEN n_left ELSE y END AS y
        FROM rep_share_{i} q LEFT JOIN
             (SELECT draw, synopsis, min(k) AS y FROM rep_sum_{i} WHERE f >= u GROUP BY ALL) USING (draw, synopsis)"""
        out[f"rep_left_{i + 1}"] = f"""
        SELECT draw, synopsis, n_left - y AS n_left, rest - p AS rest FROM rep_{i}"""
    each = [f"SELECT draw, '{level}' AS design, y FROM rep_{i}" for i, level in enumerate(levels[:-1])]
    each.append(f"SELECT draw, '{levels[-1]}', n_left FROM rep_left_{len(levels) - 1}")
    out["rep_counts"] = f"""
        SELECT draw, design, CAST(sum(y) AS DOUBLE) AS expected FROM ({' UNION ALL '.join(each)}) GROUP BY ALL"""
    return out


def digits(key: str) -> str:
    """Eight hexadecimal digits of a cluster and a draw, four draws to a hash."""
    h = f"md5({key} || '|' || CAST((draw - 1) // 4 AS VARCHAR))"
    return f"CAST('0x' || substr({h}, 8 * ((draw - 1) % 4) + 1, 8) AS BIGINT)"


def poisson_sql(h: str) -> str:
    return f"(CASE {' '.join(f'WHEN {h} < {e} THEN {k}' for k, e in enumerate(EDGES))} ELSE {len(EDGES)} END)"


# Common table expressions, each with the names of those it reads.
VIEWS: dict[str, str] = {
    "placed": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               c_mktsegment, n_nationkey,
               CASE WHEN o_totalprice < 6000 THEN 'unknown'
                    ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year_raw,
               CASE WHEN o_totalprice > 490000 THEN 'NA' ELSE
                    CAST(CAST((o_orderkey * 37) % 18000 AS DOUBLE) / 100 - 90 AS VARCHAR)
               END AS lat_raw,
               CAST(CAST((o_orderkey * 71) % 36000 AS DOUBLE) / 100 - 180 AS VARCHAR) AS long_raw,
               nullif(n_name, 'NATION_7') AS country,
               CASE WHEN n_name <> 'NATION_13' THEN r_name END AS continent
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "main_raw": """
        SELECT o_custkey AS study_id, c_mktsegment AS synopsis,
               CASE o_orderpriority || o_orderstatus
                 WHEN '1-URGENTF' THEN 'After' WHEN '1-URGENTO' THEN 'Before-After'
                 WHEN '2-HIGHF' THEN 'BACI' WHEN '2-HIGHO' THEN 'R-BACI'
                 WHEN '3-MEDIUMF' THEN 'Paired BACI' WHEN '3-MEDIUMO' THEN 'Paired R-BACI'
                 WHEN '4-NOT SPECIFIEDF' THEN 'Control-Impact'
                 WHEN '4-NOT SPECIFIEDO' THEN 'Paired Control-Impact'
                 WHEN '5-LOWF' THEN 'RCT' WHEN '5-LOWO' THEN 'Paired RCT' END AS design_raw,
               year_raw, continent, country, lat_raw, long_raw
        FROM placed WHERE o_orderstatus <> 'P'""",
    "second_raw": """
        SELECT o_custkey AS study_id, 'Non-English language' AS synopsis,
               CASE o_orderpriority
                 WHEN '1-URGENT' THEN 'After' WHEN '2-HIGH' THEN 'Before-After'
                 WHEN '3-MEDIUM' THEN 'Control-Impact' WHEN '4-NOT SPECIFIED' THEN 'BACI'
                 WHEN '5-LOW' THEN 'RCT' END AS design_raw,
               year_raw, continent, country, lat_raw, long_raw
        FROM placed WHERE o_orderstatus = 'P'""",
    "pooled": """
        SELECT study_id, synopsis, try_cast(year_raw AS INTEGER) AS year,
               CASE WHEN design_raw = 'After' THEN 'After'
                    WHEN design_raw = 'Before-After' THEN 'BA'
                    WHEN design_raw IN ('BACI', 'Paired BACI') THEN 'BACI'
                    WHEN design_raw IN ('Control-Impact', 'Paired Control-Impact') THEN 'CI'
                    ELSE 'Rand.exp.' END AS design,
               continent, country,
               try_cast(lat_raw AS DOUBLE) AS lat, try_cast(long_raw AS DOUBLE) AS long, src
        FROM (SELECT *, 1 AS src FROM main_raw UNION ALL BY NAME
              SELECT *, 2 AS src FROM second_raw)""",
    "study": "SELECT * EXCLUDE (src) FROM pooled",
    "located": """
        SELECT * FROM study WHERE lat IS NOT NULL AND long IS NOT NULL AND continent IS NOT NULL""",
    "placed_study": "SELECT * FROM study WHERE continent IS NOT NULL",
    "years": f"SELECT CAST(unnest([{', '.join(map(str, YEARS))}]) AS INTEGER) AS year",
    "nations": """
        SELECT n_nationkey AS key, n_name AS name,
               'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation""",
    "rd_long": """
        SELECT name, code, year, CASE WHEN code = 'N05' AND year = 1996 THEN NULL ELSE v END AS rd_percent
        FROM (SELECT DISTINCT name, code, key FROM nations
              WHERE key IN (SELECT n_nationkey FROM placed)) CROSS JOIN years
        LEFT JOIN (SELECT n_nationkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year,
                          avg(o_totalprice) / 100000 AS v FROM placed GROUP BY ALL)
        USING (key, year)""",
    "line_cells": """
        SELECT n_nationkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year,
               sqrt(avg(l_extendedprice)) AS gdp_pc, 10 * sqrt(avg(l_tax)) - 2 AS ge
        FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY ALL""",
    "line_long": """
        SELECT name, code, year, gdp_pc, ge
        FROM (SELECT * FROM nations WHERE key IN (SELECT key FROM line_cells)) CROSS JOIN years
        LEFT JOIN line_cells USING (key, year)""",
    "rd_gdp": """
        SELECT a.code, a.year, a.name, rd_percent, gdp_pc
        FROM rd_long a JOIN line_long b ON a.code = b.code AND a.year = b.year""",
    "rd_exp": """
        SELECT name, code, year, rd_percent / 100 * gdp_pc AS rd_pc FROM rd_gdp
        WHERE rd_percent IS NOT NULL AND gdp_pc IS NOT NULL""",
    "indic": """
        SELECT a.name, a.year, a.code, rd_pc, ge
        FROM rd_exp a JOIN line_long b ON a.name = b.name AND a.year = b.year""",
    "coded": """
        SELECT s.*, CASE WHEN country = 'NATION_3' THEN 'N03' WHEN country = 'NATION_21' THEN NULL
                         ELSE n.code END AS iso3c
        FROM study s LEFT JOIN nations n ON s.country = n.name""",
    "merged": """
        SELECT c.*, rd_pc, ge FROM coded c
        LEFT JOIN indic i ON c.iso3c IS NOT DISTINCT FROM i.code AND c.year IS NOT DISTINCT FROM i.year""",
    "model": """
        SELECT *, (rd_pc - avg(rd_pc) OVER ()) / stddev_samp(rd_pc) OVER () AS rd_pc_scaled,
               (ge - avg(ge) OVER ()) / stddev_samp(ge) OVER () AS ge_scaled
        FROM merged WHERE rd_pc IS NOT NULL AND ge IS NOT NULL""",
    "income": """
        SELECT code AS iso3c, name, year,
               CASE WHEN key <> 11 THEN (['H', 'UM', 'LM', 'L'])[(key + year) % 4 + 1] END
               AS income_category
        FROM nations CROSS JOIN years""",
    "with_income": """
        SELECT c.*, income_category,
               CASE WHEN income_category = 'H' THEN 'High income'
                    WHEN income_category IN ('L', 'LM', 'UM') THEN 'Low/Middle income' END AS income_group
        FROM (SELECT * FROM coded WHERE year BETWEEN 1995 AND 2001) c
        LEFT JOIN income i ON c.iso3c IS NOT DISTINCT FROM i.iso3c AND c.year = i.year""",
    "grouped": "SELECT * FROM with_income WHERE income_group IS NOT NULL",
    "draws_like": """
        SELECT user_id AS draw, CAST(day(ts) AS INTEGER) AS synopsis, event_type AS design,
               value AS epred FROM events""",
    "averaged": "SELECT synopsis, draw, design, avg(epred) AS epred FROM draws_like GROUP BY ALL",
    "grand": "SELECT draw, design, avg(epred) AS g FROM averaged GROUP BY ALL",
    "levels": """
        SELECT * FROM (VALUES ('After', 1), ('BA', 2), ('CI', 3), ('BACI', 4), ('Rand.exp.', 5))
        AS t(design, pos)""",
    "grid": """
        SELECT study_id, design, round_even(lat / 6, 0) * 6 + 0.0 AS lat_bin,
               round_even(long / 6, 0) * 6 + 0.0 AS long_bin FROM located""",
    "all_years": "SELECT DISTINCT year FROM placed_study WHERE year IS NOT NULL",
    "cum_places": """
        SELECT t.design, t.year, count(DISTINCT coalesce(s.country, '?')) AS cum_countries,
               count(DISTINCT coalesce(s.continent, '?')) AS cum_continents
        FROM (SELECT DISTINCT d.design, y.year FROM placed_study d CROSS JOIN all_years y) t
        JOIN placed_study s ON s.design = t.design AND s.year <= t.year GROUP BY ALL""",
    "design_year": """
        SELECT y.year, levels.design, count(s.study_id) AS n
        FROM (SELECT DISTINCT year FROM study) y CROSS JOIN levels
        LEFT JOIN study s ON s.year IS NOT DISTINCT FROM y.year AND s.design = levels.design
        GROUP BY ALL""",
    **{
        f"{c}_breaks": f"""
        SELECT [{', '.join(f'quantile_cont({v}, {i / 10})' for i in range(1, 10))}] AS b
        FROM model"""
        for c, v in (("rd", "rd_pc_scaled"), ("ge", "ge_scaled"))
    },
    **{
        f"{c}_binned": f"""
        SELECT m.*, CAST(1 + len(list_filter(b, lambda edge: {v} > edge)) AS INTEGER) AS {c}_bin
        FROM model m CROSS JOIN {c}_breaks"""
        for c, v in (("rd", "rd_pc_scaled"), ("ge", "ge_scaled"))
    },
    "boot_base": """
        SELECT study_id, synopsis, year, design, count(*) AS c FROM study GROUP BY ALL""",
    "boot": f"""
        SELECT *, CASE {' '.join(f'WHEN h < {e} THEN {k}' for k, e in enumerate(EDGES))}
                  ELSE {len(EDGES)} END AS w
        FROM (SELECT *, CAST('0x' || substr(md5(CAST(study_id AS VARCHAR) || '|' || CAST((draw - 1) // 4 AS VARCHAR)),
                                        8 * ((draw - 1) % 4) + 1, 8) AS BIGINT) AS h
              FROM boot_base CROSS JOIN
              (SELECT CAST(unnest(range(1, {DRAWS + 1})) AS INTEGER) AS draw))""",
    "boot_nested": f"""
        SELECT b.*, draw, c * {poisson_sql(digits("'country|' || coalesce(country, '\\N')"))}
                      * {poisson_sql(digits("'study_id|' || study_id"))} AS m
        FROM (SELECT country, study_id, synopsis, year, design, count(*) AS c
              FROM study WHERE year IS NOT NULL GROUP BY ALL) b CROSS JOIN
             (SELECT CAST(unnest(range(1, {DRAWS + 1})) AS INTEGER) AS draw)""",
    "boot_model": f"""
        SELECT b.*, draw, {poisson_sql(digits("'iso3c|' || coalesce(iso3c, '\\N')"))}
                      * {poisson_sql(digits("'study_id|' || study_id"))} AS m
        FROM model b CROSS JOIN (SELECT CAST(unnest(range(1, {DRAWS + 1})) AS INTEGER) AS draw)""",
    "boot_many": f"""
        SELECT draw, year, synopsis, design, sum(c * w) AS w
        FROM (SELECT b.*, draw, {poisson_sql(digits("study_id"))} AS w FROM boot_base b CROSS JOIN
              (SELECT CAST(unnest(range(1, {MANY_DRAWS + 1})) AS INTEGER) AS draw) WHERE year IS NOT NULL)
        GROUP BY ALL HAVING sum(c * w) > 0""",
    "boot_syn": """
        SELECT draw, synopsis, design, sum(c * w) AS n FROM boot GROUP BY ALL""",
    "boot_logit": """
        SELECT a.draw, a.synopsis, a.design, ln(a.n / b.n) AS v
        FROM boot_syn a JOIN boot_syn b ON a.draw = b.draw AND a.synopsis = b.synopsis
        WHERE b.design = 'After' AND a.design <> 'After'""",
    "boot_terms": """
        SELECT a.draw, a.design AS category, CASE WHEN a.synopsis = 'AUTOMOBILE' THEN '(Intercept)'
               ELSE 'synopsis=' || a.synopsis END AS term,
               CASE WHEN a.synopsis = 'AUTOMOBILE' THEN a.v ELSE a.v - b.v END AS estimate
        FROM boot_logit a JOIN boot_logit b
        ON a.draw = b.draw AND a.design = b.design AND b.synopsis = 'AUTOMOBILE'""",
    "boot_expected": """
        SELECT draw, design, sum(rows_seen * p) AS expected
        FROM (SELECT draw, synopsis, design, n / sum(n) OVER (PARTITION BY draw, synopsis) AS p
              FROM boot_syn)
        JOIN (SELECT synopsis, count(*) AS rows_seen FROM study GROUP BY ALL) USING (synopsis)
        GROUP BY ALL""",
    **replication_views(["After", "BA", "CI", "BACI", "Rand.exp."]),
    "folds": f"""
        SELECT synopsis, design, CAST('0x' || substr(md5(CAST(study_id AS VARCHAR)), 1, 8) AS BIGINT)
               % {FOLDS} AS fold FROM study""",
    "fold_sums": "SELECT fold, synopsis, design, count(*) AS n FROM folds GROUP BY ALL",
    "fold_scores": """
        SELECT h.n,
               ln((SELECT sum(n) FROM fold_sums t WHERE t.fold <> h.fold AND t.synopsis = h.synopsis
                   AND t.design = h.design) /
                  (SELECT sum(n) FROM fold_sums t WHERE t.fold <> h.fold AND t.synopsis = h.synopsis))
               AS by_group,
               ln((SELECT sum(n) FROM fold_sums t WHERE t.fold <> h.fold AND t.design = h.design) /
                  (SELECT sum(n) FROM fold_sums t WHERE t.fold <> h.fold)) AS overall
        FROM fold_sums h""",
    "fold_totals": """
        SELECT sum(n) AS n, sum(n * by_group) AS a, sum(n * overall) AS b,
               sum(n * (by_group - overall)) AS d, sum(n * (by_group - overall) ** 2) AS q
        FROM fold_scores""",
    **{
        f"loo_{name}": f"""
        SELECT study_id, sum(y * (eta - lse)) AS score FROM (
          SELECT *, ln(sum(exp(eta)) OVER (PARTITION BY study_id, grp)) AS lse FROM (
            SELECT s.study_id, s.grp, coalesce(c.y, 0) AS y,
                   ln(p) - coalesce(c.y, 0) / (p * (total - rows_own)) AS eta
            FROM (SELECT study_id, {key} AS grp, count(*) AS rows_own FROM study GROUP BY ALL) s
            JOIN (SELECT {key} AS grp, design, count(*) / sum(count(*)) OVER (PARTITION BY {key}) AS p,
                         sum(count(*)) OVER (PARTITION BY {key}) AS total FROM study GROUP BY {key}, design) g ON g.grp = s.grp
            LEFT JOIN (SELECT study_id, {key} AS grp, design, count(*) AS y FROM study GROUP BY ALL) c
              ON c.study_id = s.study_id AND c.grp = s.grp AND c.design = g.design))
        GROUP BY study_id"""
        for name, key in (("group", "synopsis"), ("overall", "'all'"))
    },
    "loo_totals": """
        SELECT count(*) AS n, sum(a.score) AS a, sum(b.score) AS b, sum(a.score - b.score) AS d,
               sum((a.score - b.score) ** 2) AS q
        FROM loo_group a JOIN loo_overall b ON a.study_id IS NOT DISTINCT FROM b.study_id""",
    "point_logit": """
        SELECT a.synopsis, a.design, ln(a.n / b.n) AS v
        FROM (SELECT synopsis, design, count(*) AS n FROM study GROUP BY ALL) a
        JOIN (SELECT synopsis, count(*) AS n FROM study WHERE design = 'After' GROUP BY ALL) b
        USING (synopsis) WHERE a.design <> 'After'""",
    "lat_knots": """
        SELECT quantile_cont(lat, 0.1) AS a, quantile_cont(lat, 0.5) AS b, quantile_cont(lat, 0.9) AS c
        FROM study""",
    "chi_cells": """
        SELECT design, income_group, count(*) AS o FROM grouped GROUP BY ALL""",
    "chi_grid": """
        SELECT r.design, c.income_group, coalesce(o, 0) AS o, rt * ct / n AS e
        FROM (SELECT design, sum(o) AS rt FROM chi_cells GROUP BY design) r
        CROSS JOIN (SELECT income_group, sum(o) AS ct FROM chi_cells GROUP BY income_group) c
        CROSS JOIN (SELECT sum(o) AS n FROM chi_cells) t
        LEFT JOIN chi_cells x ON x.design = r.design AND x.income_group = c.income_group""",
}

STUDY_COLUMNS = f"study_id, synopsis, year, design, continent, country, {r('lat')} AS lat, {r('long')} AS long"
SCALED = f"{r('rd_pc_scaled', 5)} AS rd_pc_scaled, {r('ge_scaled', 5)} AS ge_scaled"


def n_distinct(c: str) -> str:
    return f"count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0)"


def share_sql(source: str, column: str, where: str = "true") -> str:
    return f"""
        SELECT {column}, {n_distinct('study_id')} AS n,
               {r(f"({n_distinct('study_id')}) / (SELECT {n_distinct('study_id')} FROM {source} WHERE {where})")} AS share
        FROM {source} WHERE {where} GROUP BY {column}"""


def interval_sql(source: str, keys: str, value: str) -> str:
    q = {"point": 0.5, "lower": 0.025, "upper": 0.975}
    cols = ", ".join(f"{r(f'quantile_cont({value}, {p})')} AS {k}" for k, p in q.items())
    return f"""SELECT {keys}, {cols}, 0.95::DOUBLE AS width, 'median' AS point_type,
        'qi' AS interval_type FROM {source} GROUP BY {keys}"""


def logit_sql(source: str, key: str) -> str:
    return f"""
        SELECT b.{key}, o.design || ' vs. After' AS comparison,
               {r('ln(coalesce(x.n, 1) / coalesce(a.n, 1))')} AS logit_value
        FROM (SELECT DISTINCT {key} FROM {source}) b
        CROSS JOIN (SELECT design FROM levels WHERE design <> 'After') o
        LEFT JOIN (SELECT {key}, design, count(*) AS n FROM {source} GROUP BY ALL) x
          ON x.{key} = b.{key} AND x.design = o.design
        LEFT JOIN (SELECT {key}, count(*) AS n FROM {source} WHERE design = 'After' GROUP BY ALL) a
          ON a.{key} = b.{key}"""


def moment_sql(source: str, terms: dict[str, str]) -> str:
    """Observed sums of each term over the rows of each design: where a penalised fit must end."""
    return " UNION ALL ".join(
        f"""SELECT draw, design AS category, '{term}' AS term, {r(f'CAST(sum(w * {x}) AS DOUBLE)')} AS moment
        FROM {source} GROUP BY ALL"""
        for term, x in terms.items()
    )


TEMPORAL_TERMS = {"(Intercept)": "1", "year": "(year - 1998)"} | {
    f"synopsis={v}": f"CAST(synopsis = '{v}' AS INTEGER)"
    for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Non-English language")
}
DECADES = """(SELECT *, CAST(CASE WHEN year >= 1981 AND year < 1991 THEN 1981
    WHEN year >= 1991 AND year < 2001 THEN 1991 END AS INTEGER) AS year_bin FROM study)"""
FIVE_YEARS = """(SELECT *, CASE WHEN year >= 1985 AND year < 1990 THEN '1985-'
    WHEN year >= 1990 AND year < 1995 THEN '1990-'
    WHEN year >= 1995 AND year <= 2000 THEN '1995-' END AS year_bin FROM study)"""
PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
        {r(f'CAST(min({c}) AS DOUBLE)')} AS "min", {r(f'avg({c})')} AS mean,
        {r(f'CAST(max({c}) AS DOUBLE)')} AS "max",
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q1,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q3 FROM study"""
    for c in ("year", "lat", "long")
)
LABEL = """CASE p_type
    WHEN 'ECONOMY' THEN 'Management of ' || t || ' and Freshwater Conservation in ' || p_brand
    WHEN 'SMALL' THEN 'Mediterranean ' || t || ' Conservation and ' || p_brand
    WHEN 'MEDIUM' THEN 'Artificial ' || t || ' and Invasive Species'
    WHEN 'PROMO' THEN 'Biodiversity of ' || t || ' and Invertebrate Conservation'
    WHEN 'STANDARD' THEN 'Sustainable ' || t || ' Conservation'
    ELSE 'Non-English ' || t END"""
SHORT = "regexp_replace(label, ' Conservation.*', '', 'g')"
for old, new in [
    ("Management of ", ""), (" and ", " & "), ("Freshwater", "FW"), ("Invasive Species", "Inv.Sp."),
    ("Biodiversity of ", ""), ("Invertebrate", "Invert."), ("Mediterranean", "Med."),
    ("Artificial", "Art."), ("Non-English ", "NE-"), ("Sustainable ", "Sust."),
]:
    SHORT = f"replace({SHORT}, '{old}', '{new}')"


QUERIES: dict[str, str] = {
    "load_studies": "SELECT * FROM main_raw",
    "load_indicators": f"""
        SELECT name AS country_name, code AS country_code,
        {', '.join(f'''{r(f"max(CASE WHEN year = {y} THEN rd_percent END)")} AS X{y}''' for y in YEARS)}
        FROM rd_long GROUP BY name, code""",
    "load_income": f"""
        SELECT iso3c, name,
        {', '.join(f"""max(CASE WHEN year = {y} THEN income_category END) AS "{y}" """ for y in YEARS)}
        FROM income GROUP BY iso3c, name""",
    "load_prepared_studies": f"SELECT {STUDY_COLUMNS} FROM study",
    "table_head": f"""
        SELECT {STUDY_COLUMNS} FROM (SELECT * FROM study ORDER BY study_id NULLS LAST, synopsis NULLS LAST,
        year NULLS LAST, design NULLS LAST, continent NULLS LAST, country NULLS LAST, lat NULLS LAST,
        long NULLS LAST LIMIT 6)""",
    "write_summary": f"""
        SELECT synopsis, design, count(*) AS n,
               {r('count(*) / sum(count(*)) OVER (PARTITION BY synopsis)')} AS share
        FROM study GROUP BY synopsis, design""",
    "profile_table": PROFILE,
    "project_studies": "SELECT study_id, design_raw, year_raw, country FROM second_raw",
    "union_studies": f"SELECT {STUDY_COLUMNS} FROM study",
    "coerce_numeric": f"""
        SELECT study_id, try_cast(year_raw AS INTEGER) AS year, {r('try_cast(lat_raw AS DOUBLE)')} AS lat,
               {r('try_cast(long_raw AS DOUBLE)')} AS long FROM main_raw""",
    "recode_category": """
        SELECT design_raw, CASE design_raw WHEN 'Paired BACI' THEN 'BACI' WHEN 'Paired RCT' THEN 'RCT'
               WHEN 'Paired R-BACI' THEN 'R-BACI' ELSE design_raw END AS design, count(*) AS n
        FROM main_raw GROUP BY ALL""",
    "ordered_domain": """
        SELECT CASE WHEN design IN ('BA', 'CI', 'BACI') THEN design END AS design,
               CAST(CASE design WHEN 'BA' THEN 1 WHEN 'CI' THEN 2 WHEN 'BACI' THEN 3 END AS INTEGER)
               AS design_rank, count(*) AS n FROM study GROUP BY ALL""",
    "levels_present": """
        SELECT design, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS level_rank
        FROM levels WHERE design IN (SELECT design FROM study)""",
    "relevel": """
        SELECT design, CAST(CASE design WHEN 'After' THEN 1 WHEN 'BA' THEN 2 WHEN 'CI' THEN 3
               WHEN 'Rand.exp.' THEN 4 WHEN 'BACI' THEN 5 END AS INTEGER) AS level_rank, count(*) AS n
        FROM study GROUP BY ALL""",
    "reversed_labels": """
        SELECT synopsis, CAST(row_number() OVER (ORDER BY synopsis DESC) AS INTEGER) AS position
        FROM (SELECT DISTINCT synopsis FROM study WHERE synopsis IS NOT NULL)""",
    "normalise_missing": """
        SELECT study_id, nullif(lat_raw, 'NA') IS NULL AS lat_missing, count(*) AS n
        FROM main_raw GROUP BY ALL""",
    "derived_indicator": f"SELECT name, code, year, {r('rd_pc')} AS rd_pc FROM rd_exp",
    "income_group": """
        SELECT income_category, income_group, count(*) AS n FROM with_income GROUP BY ALL""",
    "complete_rows": f"SELECT {STUDY_COLUMNS} FROM located",
    "filter_equal": f"""
        SELECT {STUDY_COLUMNS} FROM study
        WHERE synopsis <> 'Non-English language' AND continent = 'EUROPE'""",
    "year_range": f"SELECT {STUDY_COLUMNS} FROM study WHERE year >= 1996 AND year <= 1999",
    "consistent_multi_group": f"""
        SELECT study_id, {n_distinct('synopsis')} AS n_groups, {n_distinct('design')} AS n_categories
        FROM study GROUP BY study_id
        HAVING {n_distinct('synopsis')} >= 2 AND {n_distinct('design')} = 1""",
    "keep_listed": f"""
        SELECT {STUDY_COLUMNS} FROM study WHERE study_id IN
        (SELECT study_id FROM study GROUP BY study_id HAVING {n_distinct('synopsis')} >= 2)""",
    "drop_listed": f"""
        SELECT country, count(*) AS n FROM study GROUP BY country
        HAVING {n_distinct('study_id')} >=
        (SELECT avg(k) FROM (SELECT {n_distinct('study_id')} AS k FROM study GROUP BY country))""",
    "coverage_filter": f"""
        SELECT {STUDY_COLUMNS} FROM study WHERE study_id IN
        (SELECT study_id FROM study GROUP BY study_id HAVING {n_distinct('design')} >= 5)""",
    "coverage_filter_country": f"""
        SELECT country, count(*) AS n FROM study GROUP BY country
        HAVING {n_distinct('design')} >= 5""",
    "multi_category_ids": f"""
        SELECT study_id, {n_distinct('design')} AS n_categories FROM study GROUP BY study_id
        HAVING {n_distinct('design')} > 1""",
    "lowest_coverage": f"""
        SELECT study_id, {n_distinct('design')} AS n_categories FROM study GROUP BY study_id
        ORDER BY n_categories, study_id LIMIT 20""",
    "join_indicators": f"""
        SELECT name, code, year, {r('rd_percent')} AS rd_percent, {r('gdp_pc')} AS gdp_pc FROM rd_gdp""",
    "join_third_indicator": f"""
        SELECT name, code, year, {r('rd_pc')} AS rd_pc, {r('ge')} AS ge FROM indic""",
    "attach_indicators": f"""
        SELECT study_id, synopsis, year, design, continent, country, {r('lat')} AS lat,
               {r('long')} AS long, iso3c, {r('rd_pc')} AS rd_pc, {r('ge')} AS ge FROM merged""",
    "attach_income": f"SELECT {STUDY_COLUMNS}, iso3c, income_category FROM with_income",
    "covariate_grid": """
        SELECT synopsis, year FROM (SELECT DISTINCT synopsis FROM study)
        CROSS JOIN (SELECT DISTINCT year FROM study)""",
    "standardise_names": "SELECT country, iso3c, count(*) AS n FROM coded GROUP BY ALL",
    "unmatched_names": """
        SELECT DISTINCT country FROM coded WHERE iso3c IS NULL AND country IS NOT NULL""",
    "unmatched_income": """
        SELECT DISTINCT c.iso3c, c.country, c.year FROM coded c
        WHERE iso3c IS NOT NULL AND year IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM income i WHERE i.iso3c = c.iso3c AND i.year = c.year
         AND income_category IS NOT NULL)""",
    "codes_missing_left": """
        SELECT iso3c FROM coded EXCEPT SELECT code FROM indic""",
    "codes_missing_right": """
        SELECT code AS iso3c FROM indic EXCEPT SELECT iso3c FROM coded""",
    "count_by_keys": "SELECT year, synopsis, design, count(*) AS n FROM study GROUP BY ALL",
    "designs_by_year": f"SELECT year, {n_distinct('design')} AS n_categories FROM study GROUP BY year",
    "designs_by_group": f"""
        SELECT synopsis, {n_distinct('country')} AS n_countries FROM study GROUP BY synopsis""",
    "designs_by_country": f"""
        SELECT iso3c, {n_distinct('design')} AS n_categories FROM coded GROUP BY iso3c""",
    "distinct_studies": "SELECT " + ", ".join(
        f"{n_distinct(c)} AS n_{c}" for c in ("study_id", "synopsis", "design", "year", "country", "continent")
    ) + " FROM study",
    "share_overall": share_sql("study", "design"),
    "share_subset": share_sql("study", "design", "synopsis = 'Non-English language'"),
    "share_complement": share_sql("study", "design", "synopsis <> 'Non-English language'"),
    "share_by_continent": share_sql("located", "continent"),
    "share_by_country": share_sql("study", "country"),
    "pct_continent": f"""
        SELECT continent, count(*) AS n, {r('count(*) / sum(count(*)) OVER () * 100')} AS percentage
        FROM placed_study GROUP BY continent""",
    "pct_design_in_continent": f"""
        SELECT continent, design, count(*) AS n,
               {r('count(*) / sum(count(*)) OVER (PARTITION BY continent) * 100')} AS percentage
        FROM placed_study GROUP BY continent, design""",
    "pct_design_global": f"""
        SELECT design, count(*) AS n, {r('count(*) / sum(count(*)) OVER () * 100')} AS percentage
        FROM placed_study GROUP BY design""",
    "prop_design_in_continent": f"""
        SELECT continent, design, n_studies,
               {r('n_studies / sum(n_studies) OVER (PARTITION BY continent)')} AS proportion
        FROM (SELECT continent, design, {n_distinct('study_id')} AS n_studies
              FROM located GROUP BY ALL)""",
    "composition_by_synopsis": f"""
        SELECT synopsis, design, n_studies, {r('n_studies / total_studies')} AS proportion, total_studies
        FROM (SELECT *, CAST(sum(n_studies) OVER (PARTITION BY synopsis) AS BIGINT) AS total_studies
              FROM (SELECT synopsis, design, count(*) AS n_studies FROM study GROUP BY ALL))""",
    "binned_composition": f"""
        SELECT year_bin, design, count(*) AS n,
               {r('count(*) / sum(count(*)) OVER (PARTITION BY year_bin)')} AS proportion
        FROM {FIVE_YEARS} WHERE year_bin IS NOT NULL GROUP BY year_bin, design""",
    "group_order": f"""
        SELECT synopsis, {r('share')} AS share,
               CAST(row_number() OVER (ORDER BY share DESC, synopsis) AS INTEGER) AS position
        FROM (SELECT synopsis, avg(CASE WHEN design = 'After' THEN 1.0 ELSE 0.0 END) AS share
              FROM study GROUP BY synopsis HAVING count(*) FILTER (WHERE design = 'After') > 0)""",
    "grid_counts": """
        SELECT lat_bin, long_bin, design, count(*) AS n_studies FROM grid GROUP BY ALL
        UNION ALL SELECT lat_bin, long_bin, 'All designs', count(*) FROM grid GROUP BY ALL""",
    "grid_counts_distinct": f"""
        SELECT lat_bin, long_bin, design, {n_distinct('study_id')} AS n_studies FROM grid
        GROUP BY lat_bin, long_bin, design
        UNION ALL SELECT lat_bin, long_bin, 'All designs', {n_distinct('study_id')} FROM grid
        GROUP BY lat_bin, long_bin""",
    "median_interval": interval_sql("draws_like", "synopsis, design", "epred"),
    "median_interval_large": f"""
        SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.025)')} AS lower,
               {r('quantile_cont(l_extendedprice, 0.5)')} AS point,
               {r('quantile_cont(l_extendedprice, 0.975)')} AS upper
        FROM lineitem GROUP BY l_returnflag""",
    "row_counts": """
        SELECT 'study' AS table_name, count(*) AS n_rows FROM study
        UNION ALL SELECT 'located', count(*) FROM located
        UNION ALL SELECT 'merged', count(*) FROM merged
        UNION ALL SELECT 'model', count(*) FROM model""",
    "contingency": """
        SELECT design, count(*) FILTER (WHERE income_group = 'High income') AS "High income",
               count(*) FILTER (WHERE income_group = 'Low/Middle income') AS "Low/Middle income"
        FROM grouped GROUP BY design""",
    "pearson_residuals": f"""
        SELECT design, income_group, CAST(o AS BIGINT) AS observed, {r('e')} AS expected,
               {r('o - e')} AS residual, {r('(o - e) / sqrt(e)')} AS pearson_residual,
               CASE WHEN (o - e) / sqrt(e) > 2 THEN 'Over-represented'
                    WHEN (o - e) / sqrt(e) < -2 THEN 'Under-represented'
                    ELSE 'As Expected' END AS representation FROM chi_grid WHERE o > 0""",
    "chi_squared": f"""
        SELECT {r('x')} AS statistic, 4 AS df, {r('exp(-x / 2) * (1 + x / 2)')} AS p_value
        FROM (SELECT sum((o - e) * (o - e) / e) AS x FROM chi_grid)""",
    "residual_matrix": f"""
        SELECT design, income_group, CAST(o AS BIGINT) AS observed,
               {r('(o - e) / sqrt(e)')} AS pearson_residual FROM chi_grid""",
    "standardise": f"SELECT study_id, iso3c, year, {SCALED} FROM model",
    "empirical_logit_decade": logit_sql(
        f"(SELECT * FROM {DECADES} WHERE year_bin IS NOT NULL)", "year_bin"
    ),
    "empirical_logit_quantile": logit_sql("rd_binned", "rd_bin"),
    "empirical_logit_quantile_ge": logit_sql("ge_binned", "ge_bin"),
    "pivot_fill": """
        SELECT study_id, """ + ", ".join(
        f"""CASE WHEN count(*) FILTER (WHERE design = '{x}') = 0 THEN 1
            ELSE count(*) FILTER (WHERE design = '{x}') END AS "{x}" """
        for x in ("After", "BA", "CI", "BACI", "Rand.exp.")
    ) + " FROM study GROUP BY study_id",
    "complete_grid": """
        WITH n2 AS (SELECT year, country, count(*) AS n FROM study GROUP BY ALL),
        lv AS (SELECT 'NATION_' || i AS country FROM range(26) t(i)
               UNION ALL SELECT NULL WHERE EXISTS (SELECT 1 FROM n2 WHERE country IS NULL))
        SELECT y.year, lv.country, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT year FROM n2) y CROSS JOIN lv
        LEFT JOIN n2 ON n2.year IS NOT DISTINCT FROM y.year
                    AND n2.country IS NOT DISTINCT FROM lv.country""",
    "cumulative_counts": """
        SELECT year, design, n, CAST(sum(n) OVER (PARTITION BY design ORDER BY year NULLS LAST) AS BIGINT)
               AS cum_n FROM design_year""",
    "cumulative_share": f"""
        SELECT d.year, design, n, cum_n, total_cum_n, {r('cum_n / total_cum_n')} AS cum_share
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY design ORDER BY year NULLS LAST) AS BIGINT) AS cum_n
              FROM design_year) d
        JOIN (SELECT year, CAST(sum(t) OVER (ORDER BY year NULLS LAST) AS BIGINT) AS total_cum_n
              FROM (SELECT year, count(*) AS t FROM study GROUP BY year)) t
        ON d.year IS NOT DISTINCT FROM t.year WHERE total_cum_n > 0""",
    "cumulative_distinct": "SELECT design, year, cum_countries, cum_continents FROM cum_places",
    "cumulative_distinct_studies": """
        SELECT synopsis, year, count(DISTINCT id) AS cum_studies
        FROM (SELECT s.synopsis, y.year, s.study_id AS id FROM study s
              JOIN (SELECT DISTINCT year FROM study WHERE year IS NOT NULL) y ON s.year <= y.year)
        GROUP BY ALL""",
    "cumulative_max": """
        SELECT max(cum_countries) AS max_cum_countries, max(cum_continents) AS max_cum_continents
        FROM cum_places""",
    "distinct_labels": "SELECT DISTINCT continent, country, design FROM study",
    "unpivot_indicators": f"SELECT name, code, year, {r('rd_percent')} AS rd_percent FROM rd_long",
    "unpivot_income": "SELECT iso3c, name, year, income_category FROM income",
    "bin_decade": f"""
        SELECT year_bin, year, count(*) AS n FROM {DECADES} WHERE year_bin IS NOT NULL GROUP BY ALL""",
    "bin_five_year": f"""
        SELECT year_bin, year, count(*) AS n FROM {FIVE_YEARS} WHERE year_bin IS NOT NULL GROUP BY ALL""",
    "bin_quantile": "SELECT rd_bin, iso3c, year, count(*) AS n FROM rd_binned GROUP BY ALL",
    "bin_quantile_ge": "SELECT ge_bin, iso3c, year, count(*) AS n FROM ge_binned GROUP BY ALL",
    "bin_grid": "SELECT study_id, lat_bin, long_bin FROM grid",
    "shorten_labels": f"""
        SELECT label, count(*) AS n, {SHORT} AS short_label
        FROM (SELECT {LABEL} AS label FROM
              (SELECT *, list_aggregate(list_transform(string_split(p_name, ' '),
                      lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS t FROM part))
        GROUP BY label""",
    "multinomial_fit_saturated": f"""
        SELECT a.design AS category, CASE WHEN a.synopsis = 'AUTOMOBILE' THEN '(Intercept)'
               ELSE 'synopsis=' || a.synopsis END AS term,
               {r("CASE WHEN a.synopsis = 'AUTOMOBILE' THEN a.v ELSE a.v - b.v END")} AS estimate
        FROM point_logit a JOIN point_logit b ON a.design = b.design AND b.synopsis = 'AUTOMOBILE'""",
    "spline_features": f"""
        SELECT study_id, {r('lat')} AS lat, {r('''(greatest(lat - a, 0) ** 3
               - greatest(lat - b, 0) ** 3 * ((c - a) / (c - b))
               + greatest(lat - c, 0) ** 3 * ((b - a) / (c - b))) / (c - a) ** 2''')} AS lat_spline
        FROM study CROSS JOIN lat_knots WHERE lat IS NOT NULL""",
    "bootstrap_cells": """
        SELECT draw, year, synopsis, design, CAST(sum(c * w) AS BIGINT) AS n FROM boot
        WHERE w > 0 AND year IS NOT NULL GROUP BY ALL""",
    "multinomial_draws_saturated": f"""
        SELECT draw, category, term, {r('estimate')} AS estimate FROM boot_terms""",
    "coefficient_summary_saturated": f"""
        SELECT category, term, {r('avg(estimate)')} AS estimate,
               {r('stddev_samp(estimate)')} AS std_error,
               {r('quantile_cont(estimate, 0.025)')} AS conf_low,
               {r('quantile_cont(estimate, 0.975)')} AS conf_high
        FROM boot_terms GROUP BY category, term""",
    "predictive_check_replicated_saturated": f"""
        SELECT e.design, {r('point')} AS point, {r('lower')} AS lower, {r('upper')} AS upper,
               0.95::DOUBLE AS width, 'median' AS point_type, 'qi' AS interval_type, observed
        FROM (SELECT design, quantile_cont(expected, 0.5) AS point, quantile_cont(expected, 0.025) AS lower,
                     quantile_cont(expected, 0.975) AS upper FROM rep_counts GROUP BY design) e
        JOIN (SELECT design, count(*) AS observed FROM study GROUP BY design) o ON e.design = o.design""",
    "predictive_check_saturated": f"""
        SELECT e.design, {r('point')} AS point, {r('lower')} AS lower, {r('upper')} AS upper,
               0.95::DOUBLE AS width, 'median' AS point_type, 'qi' AS interval_type, observed
        FROM (SELECT design, quantile_cont(expected, 0.5) AS point, quantile_cont(expected, 0.025) AS lower,
                     quantile_cont(expected, 0.975) AS upper FROM boot_expected GROUP BY design) e
        JOIN (SELECT design, count(*) AS observed FROM study GROUP BY design) o ON e.design = o.design""",
    "elpd_compare_saturated": f"""
        SELECT 'by_group' AS model, {r('a')} AS elpd, {r('least(a - b, 0)')} AS elpd_diff,
               CASE WHEN a >= b THEN 0.0::DOUBLE ELSE {r('sqrt(n * (q - d * d / n) / (n - 1))')} END AS se_diff
        FROM fold_totals
        UNION ALL
        SELECT 'overall', {r('b')}, {r('least(b - a, 0)')},
               CASE WHEN b > a THEN 0.0::DOUBLE ELSE {r('sqrt(n * (q - d * d / n) / (n - 1))')} END
        FROM fold_totals""",
    "elpd_loo_saturated": f"""
        SELECT 'by_group' AS model, {r('a')} AS elpd, {r('least(a - b, 0)')} AS elpd_diff,
               CASE WHEN a >= b THEN 0.0::DOUBLE ELSE {r('sqrt(n * (q - d * d / n) / (n - 1))')} END AS se_diff
        FROM loo_totals
        UNION ALL
        SELECT 'overall', {r('b')}, {r('least(b - a, 0)')},
               CASE WHEN b > a THEN 0.0::DOUBLE ELSE {r('sqrt(n * (q - d * d / n) / (n - 1))')} END
        FROM loo_totals""",
    "keep_fit_saturated": f"""
        SELECT synopsis, design, {r('ln(count(*) / sum(count(*)) OVER (PARTITION BY synopsis))')} AS log_probability
        FROM study GROUP BY synopsis, design""",
    "epred_draws_saturated": f"""
        SELECT synopsis, draw, design, {r('ln(n / sum(n) OVER (PARTITION BY draw, synopsis))')} AS log_epred
        FROM boot_syn""",
    "averaged_probability": f"SELECT synopsis, draw, design, {r('epred', 9)} AS epred FROM averaged",
    "grand_mean": f"SELECT draw, design, {r('g', 9)} AS grand_mean_epred FROM grand",
    "group_vs_grand_mean": f"""
        SELECT o.design, synopsis, {r('op', 9)} AS point_group, {r('ol', 9)} AS lower_group,
               {r('ou', 9)} AS upper_group, 0.95::DOUBLE AS width_group, 'median' AS point_type_group,
               'qi' AS interval_type_group, {r('gp', 9)} AS point_grand_mean, {r('gl', 9)} AS lower_grand_mean,
               {r('gu', 9)} AS upper_grand_mean, 0.95::DOUBLE AS width_grand_mean,
               'median' AS point_type_grand_mean, 'qi' AS interval_type_grand_mean,
               ol > gu OR ou < gl AS is_significant,
               CASE WHEN ol > gu THEN 'Higher than average' WHEN ou < gl THEN 'Lower than average'
                    ELSE 'Not significant' END AS direction
        FROM (SELECT synopsis, design, quantile_cont(epred, 0.5) AS op, quantile_cont(epred, 0.025) AS ol,
                     quantile_cont(epred, 0.975) AS ou FROM averaged GROUP BY ALL) o
        JOIN (SELECT design, quantile_cont(g, 0.5) AS gp, quantile_cont(g, 0.025) AS gl,
                     quantile_cont(g, 0.975) AS gu FROM grand GROUP BY ALL) g ON o.design = g.design""",
    "multinomial_fit_moments": moment_sql(
        "(SELECT 1 AS draw, design, synopsis, year, 1 AS w FROM study WHERE year IS NOT NULL)", TEMPORAL_TERMS
    ),
    "multinomial_fit_geography_moments": moment_sql(
        "(SELECT 1 AS draw, *, 1 AS w FROM model)",
        {"(Intercept)": "1", "rd_pc_scaled": "rd_pc_scaled", "ge_scaled": "ge_scaled"},
    ),
    "multinomial_draws_moments": moment_sql(
        "(SELECT draw, design, synopsis, year, c * w AS w FROM boot WHERE year IS NOT NULL)", TEMPORAL_TERMS
    ),
    "bootstrap_cells_nested": """
        SELECT draw, year, synopsis, design, CAST(sum(m) AS BIGINT) AS n FROM boot_nested
        GROUP BY ALL HAVING sum(m) > 0""",
    "multinomial_draws_nested_moments": moment_sql(
        "(SELECT draw, design, rd_pc_scaled, ge_scaled, m AS w FROM boot_model)",
        {"(Intercept)": "1", "rd_pc_scaled": "rd_pc_scaled", "ge_scaled": "ge_scaled"},
    ),
    "multinomial_many_draws_moments": moment_sql("boot_many", TEMPORAL_TERMS),
    "epred_draws_moments": f"""
        SELECT draw, design, {r('CAST(sum(c * w) AS DOUBLE)')} AS expected
        FROM boot WHERE year IS NOT NULL GROUP BY ALL""",
    "vif": f"""
        SELECT unnest(['rd_pc_scaled', 'ge_scaled']) AS term, {r('1 / (1 - c * c)')} AS vif
        FROM (SELECT corr(rd_pc_scaled, ge_scaled) AS c FROM model)""",
}


def used_views(sql: str) -> list[str]:
    """The views a statement reads, directly or through others, in definition order."""
    import re

    words = set(re.findall(r"\w+", sql))
    wanted: set[str] = set()
    for name in reversed(list(VIEWS)):
        if name in words:
            wanted.add(name)
            words |= set(re.findall(r"\w+", VIEWS[name]))
    return [v for v in VIEWS if v in wanted]


def all_sql() -> dict[str, str]:
    out = {}
    for name, body in QUERIES.items():
        views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used_views(body))
        body = body.strip()
        if views and body.upper().startswith("WITH "):
            out[name] = f"WITH {views},\n{body[5:]}"
        else:
            out[name] = f"WITH {views}\n{body}" if views else body
    return out
