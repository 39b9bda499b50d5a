"""Movie-revenue exploration: missing-value profile, NULL drop, year
extraction, category codes, correlation matrix and pairs, regression line.

Input: ``movies`` (movie_id, released, company, budget, gross, votes).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orchard.functions.parse import first_year
from orchard.operators.relational import category_codes
from orchard.operators.stats import corr_pairs, missing_percent, regression_line
from orchard.sources import views as V


def with_year(m):
    return m.withColumn("yearcorrect", first_year(F.col("released")))


def complete(spark, d):
    """The movies table after dropping rows with any NULL, with the year."""
    return with_year(V.movies(spark, d).na.drop("any"))


def numerized(spark, d):
    m = complete(spark, d)
    text = [f.name for f in m.schema.fields if isinstance(f.dataType, StringType)]
    coded = category_codes(m, text, "_code")
    return coded.select(*[F.col(c + "_code").alias(c) if c in text else F.col(c) for c in m.columns])


CORR_COLS = ["released", "company", "budget", "gross", "votes", "yearcorrect"]


def q_movies_missing_pct(spark, d):
    return missing_percent(V.movies(spark, d))


def q_movies_missing_drop(spark, d):
    return V.movies(spark, d).na.drop("any")


def q_movies_release_year(spark, d):
    return complete(spark, d).select("movie_id", "yearcorrect")


def q_movies_category_codes(spark, d):
    return numerized(spark, d).select("movie_id", F.col("released").alias("released_code"),
                                      F.col("company").alias("company_code"))


def q_movies_corr(spark, d):
    return corr_pairs(numerized(spark, d), CORR_COLS)


def q_movies_corr_pairs(spark, d):
    return corr_pairs(numerized(spark, d), CORR_COLS).where(F.col("corr") > 0.5).orderBy("corr")


def q_movies_regression_line(spark, d):
    return regression_line(complete(spark, d), "gross", "budget")


QUERIES = {
    "movies_missing_pct": q_movies_missing_pct,
    "movies_missing_drop": q_movies_missing_drop,
    "movies_release_year": q_movies_release_year,
    "movies_category_codes": q_movies_category_codes,
    "movies_corr": q_movies_corr,
    "movies_corr_pairs": q_movies_corr_pairs,
    "movies_regression_line": q_movies_regression_line,
}

_M = ("movies",)
_COMPLETE = """complete AS (SELECT *, TRY_CAST(nullif(regexp_extract(released, '([0-9]{4})', 1), '') AS INTEGER) AS yearcorrect
  FROM movies WHERE movie_id IS NOT NULL AND released IS NOT NULL AND company IS NOT NULL AND budget IS NOT NULL
  AND gross IS NOT NULL AND votes IS NOT NULL),
num AS (SELECT movie_id, CAST(dense_rank() OVER (ORDER BY released) - 1 AS INTEGER) AS released,
  CAST(dense_rank() OVER (ORDER BY company) - 1 AS INTEGER) AS company, budget, gross, votes, yearcorrect FROM complete)"""


def _m(sql):
    body = V.with_views("SELECT 1", *_M)
    return body[: body.rindex("\nSELECT 1")] + f",\n{_COMPLETE}\n{sql}"


def _corr(where=""):
    from orchard.plans.population import corr_sql
    return corr_sql("num", CORR_COLS)


ORACLE = {
    "movies_missing_pct": V.with_views(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 0) AS pct_missing FROM movies"
        for c in ["movie_id", "released", "company", "budget", "gross", "votes"]), *_M),
    "movies_missing_drop": V.with_views(
        "SELECT * FROM movies WHERE budget IS NOT NULL AND released IS NOT NULL AND company IS NOT NULL "
        "AND gross IS NOT NULL AND votes IS NOT NULL AND movie_id IS NOT NULL", *_M),
    "movies_release_year": _m("SELECT movie_id, yearcorrect FROM complete"),
    "movies_category_codes": _m("SELECT movie_id, released AS released_code, company AS company_code FROM num"),
    "movies_corr": _m(_corr()),
    "movies_corr_pairs": _m(f"SELECT * FROM ({_corr()}) p WHERE corr > 0.5 ORDER BY corr"),
    "movies_regression_line": _m(
        """SELECT round(regr_slope(gross, budget), 6) AS slope, round(regr_intercept(gross, budget), 6) AS intercept,
             round(regr_r2(gross, budget), 6) AS r2, CAST(regr_count(gross, budget) AS BIGINT) AS n FROM complete"""),
}
