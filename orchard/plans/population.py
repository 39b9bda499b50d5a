"""World-population style exploration: top countries, correlation, means by
continent, text filter, series, transpose and box-plot numbers.

Input: ``population`` (country, continent, p1970, p2000, p2022).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orchard.operators.relational import top_k, wide_to_long
from orchard.operators.stats import box_stats, corr_pairs
from orchard.sources import views as V
from orchard.sources.tables import table

YEARS = {"p1970": 1970, "p2000": 2000, "p2022": 2022}
POP_COLS = list(YEARS)


def continent_means(pop, digits: int = 6):
    return pop.groupBy("continent").agg(*[F.round(F.avg(c), digits).alias(c) for c in POP_COLS])


def q_population_top10(spark, d):
    return top_k(V.population(spark, d), [F.desc("p2022"), F.asc("country")], 10)


def q_population_corr(spark, d):
    return corr_pairs(V.population(spark, d), POP_COLS)


def q_population_continent_means(spark, d):
    return continent_means(V.population(spark, d)).orderBy(F.desc("p2022"))


def q_population_contains(spark, d):
    # regex semantics of str.contains; the stand-in continents are region names
    return V.population(spark, d).where(F.col("continent").rlike("AMERICA"))


def _series(spark, d):
    m = continent_means(V.population(spark, d))
    long = wide_to_long(m, ["continent"], POP_COLS, "col", "avg_population")
    year = F.lit(None).cast("int")
    for c, y in YEARS.items():
        year = F.when(F.col("col") == c, F.lit(y)).otherwise(year)
    return long.select("continent", year.alias("year"), "avg_population")


def q_population_series(spark, d):
    return _series(spark, d)


def q_population_transpose(spark, d):
    # pivot values: the continent dimension (a bounded lookup table)
    names = sorted(r[0] for r in table(spark, d, "region").select("r_name").distinct().collect())
    return _series(spark, d).groupBy("year").pivot("continent", names).agg(F.first("avg_population"))


def q_population_box_stats(spark, d):
    return box_stats(V.population(spark, d), POP_COLS)


QUERIES = {
    "population_top10": q_population_top10,
    "population_corr": q_population_corr,
    "population_continent_means": q_population_continent_means,
    "population_contains": q_population_contains,
    "population_series": q_population_series,
    "population_transpose": q_population_transpose,
    "population_box_stats": q_population_box_stats,
}


def corr_sql(view: str, cols, where: str = "") -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM {view}{where}")
    return " UNION ALL ".join(parts)


_P = ("population",)
_MEANS = "SELECT continent, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in POP_COLS) + \
    " FROM population GROUP BY continent"
_SERIES = " UNION ALL ".join(
    f"SELECT continent, CAST({y} AS INTEGER) AS year, {c} AS avg_population FROM m" for c, y in YEARS.items())
_BOX = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
          round(q3 - q1, 6) AS iqr,
          (SELECT min(CAST({c} AS DOUBLE)) FROM population WHERE {c} >= q1 - 1.5*(q3-q1)) AS whisker_low,
          (SELECT max(CAST({c} AS DOUBLE)) FROM population WHERE {c} <= q3 + 1.5*(q3-q1)) AS whisker_high,
          (SELECT count(*) FROM population WHERE {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1)) AS n_outliers
        FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) med,
                     quantile_cont(CAST({c} AS DOUBLE), 0.75) q3 FROM population) s""" for c in POP_COLS)

ORACLE = {
    "population_top10": V.with_views("SELECT * FROM population ORDER BY p2022 DESC, country LIMIT 10", *_P),
    "population_corr": V.with_views(corr_sql("population", POP_COLS), *_P),
    "population_continent_means": V.with_views(_MEANS + " ORDER BY p2022 DESC", *_P),
    "population_contains": V.with_views("SELECT * FROM population WHERE regexp_matches(continent, 'AMERICA')", *_P),
    "population_series": V.with_views(f"SELECT * FROM (WITH m AS ({_MEANS}) {_SERIES}) s", *_P),
    "population_transpose": V.with_views(
        f"""SELECT year, """ + ", ".join(
            f"first(avg_population) FILTER (WHERE continent = '{n}') AS \"{n}\""
            for n in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]) +
        f""" FROM (WITH m AS ({_MEANS}) {_SERIES}) s GROUP BY year""", *_P),
    "population_box_stats": V.with_views(_BOX, *_P),
}
