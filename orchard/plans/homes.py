"""House-price workflow: parsing sizes and areas, rare-location grouping,
per-location outlier removal, one-hot encoding and a linear price model
that is trained once, stored, and used for batch scoring.

Input: ``homes`` (home_id, location, size, total_sqft, bath, price).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.functions.parse import is_number, leading_int, range_or_number
from orchard.functions.text import strip_ws
from orchard.operators.relational import attach_group_stats, grand_total
from orchard.sources import views as V

RARE_MAX_ROWS = 10
MIN_SQFT_PER_BHK = 300
MODEL_SEED = 10
MODEL_VERSION = "price-2"  # changes with the code that trains


def parsed(h: DataFrame) -> DataFrame:
    """NULL rows dropped, bedrooms and area parsed, price per sqft."""
    h = h.na.drop("any")
    return (h.withColumn("bhk", leading_int(F.col("size")))
            .withColumn("total_sqft", range_or_number(F.col("total_sqft")))
            .na.drop(subset=["total_sqft"])
            .withColumn("price_per_sqft", F.col("price") * 100000 / F.col("total_sqft"))
            .withColumn("location", strip_ws(F.col("location"))))


def group_rare(h: DataFrame, max_rows: int = RARE_MAX_ROWS) -> DataFrame:
    """Locations with at most ``max_rows`` rows become 'other'."""
    with_n = attach_group_stats(h, ["location"], F.count(F.lit(1)).alias("_loc_rows"))
    return (with_n.withColumn("location", F.when(F.col("_loc_rows") <= max_rows, F.lit("other"))
                              .otherwise(F.col("location"))).drop("_loc_rows"))


def plausible_area(h: DataFrame) -> DataFrame:
    """Drop rows with less than 300 sqft per bedroom; keep undefined ratios."""
    small = F.try_divide(F.col("total_sqft"), F.col("bhk")) < MIN_SQFT_PER_BHK
    return h.where(F.coalesce(~small, F.lit(True)))


def drop_price_outliers(h: DataFrame) -> DataFrame:
    """Keep rows with price per sqft in (mean - std, mean + std] of their
    location (population std)."""
    s = attach_group_stats(h, ["location"], F.avg("price_per_sqft").alias("_m"),
                           F.stddev_pop("price_per_sqft").alias("_s"))
    pps, m, sd = F.col("price_per_sqft"), F.col("_m"), F.col("_s")
    return s.where((pps > m - sd) & (pps <= m + sd)).drop("_m", "_s")


def sane_baths(h: DataFrame) -> DataFrame:
    return h.where(F.col("bath") < F.col("bhk") + 2)


def cleaned(h: DataFrame) -> DataFrame:
    return sane_baths(drop_price_outliers(plausible_area(group_rare(parsed(h))))).drop("size", "price_per_sqft")


def one_hot_long(h: DataFrame) -> DataFrame:
    """Sparse one-hot of location with the first (alphabetical) level
    dropped: one row per non-zero dummy."""
    first = grand_total(h, F.min("location"))
    return h.where(F.col("location") != first).select(
        "home_id", F.col("location").alias("dummy_column"), F.lit(1.0).alias("dummy_value"))


# ------------------------------------------------------------------ queries

def q_homes_features(spark, d):
    h = sane_baths(plausible_area(parsed(V.homes(spark, d))))
    return h.select("home_id", "location", "bhk", "total_sqft", "bath", "price",
                    F.round("price_per_sqft", 6).alias("price_per_sqft"))


def q_homes_rare_location(spark, d):
    return group_rare(parsed(V.homes(spark, d))).select("home_id", "location")


def q_homes_outliers(spark, d):
    h = drop_price_outliers(plausible_area(group_rare(parsed(V.homes(spark, d)))))
    return h.select("home_id", "location", "bhk", "total_sqft", "bath", "price",
                    F.round("price_per_sqft", 6).alias("price_per_sqft"))


def q_homes_one_hot(spark, d):
    return one_hot_long(cleaned(V.homes(spark, d)))


def q_homes_numeric_share(spark, d):
    h = V.homes(spark, d)
    return h.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count(F.when(is_number(F.col("total_sqft")), 1)).alias("n_numeric")) \
        .withColumn("share", F.round(F.col("n_numeric") / F.col("n_rows"), 6))


def q_homes_locations(spark, d):
    h = cleaned(V.homes(spark, d))
    first = grand_total(h, F.min("location"))
    return h.where(F.col("location") != first).select("location").distinct().orderBy("location")


FEATURES = ["total_sqft", "bath", "bhk"]


def price_model(spark, d):
    """Least squares with an intercept per location, fitted to the training rows once per content
    of the cleaned table; changed rows give another key and are trained anew."""
    from orchard.operators.linear import fit_or_load, fit_within
    from orchard.operators.models import content_key
    from orchard.operators.sampling import hash_split
    from orchard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    store = spark.conf.get("spark.checkpoint.dir")
    homes = cleaned(V.homes(spark, d))
    data = hash_split(homes, "home_id", MODEL_SEED)
    path = f"{store}/orchard-models/price-{content_key(homes, f'{MODEL_VERSION}|{MODEL_SEED}')}"
    model = fit_or_load(spark, path, lambda: fit_within(data.where(F.col("split") == "train"), "location", FEATURES, "price"))
    return data, model


def q_homes_price_model(spark, d):
    """Prices of the held-out rows by the stored model."""
    from orchard.operators.linear import predict_within
    data, model = price_model(spark, d)
    return predict_within(data.where(F.col("split") == "test"), "location", FEATURES, model).select(
        "home_id", "location", "price", F.round("prediction", 2).alias("predicted_price"))


def q_homes_price_requests(spark, d):
    """Every listing as a price request, rare locations and outliers included: a location that the
    model does not know is priced as 'other'."""
    from orchard.operators.linear import predict_within
    requests = parsed(V.homes(spark, d)).select("home_id", "location", *FEATURES)
    return predict_within(requests, "location", FEATURES, price_model(spark, d)[1]).withColumn(
        "predicted_price", F.round("prediction", 2)).drop("prediction")


QUERIES = {
    "homes_features": q_homes_features,
    "homes_rare_location": q_homes_rare_location,
    "homes_outliers": q_homes_outliers,
    "homes_one_hot": q_homes_one_hot,
    "homes_numeric_share": q_homes_numeric_share,
    "homes_locations": q_homes_locations,
    "homes_price_model": q_homes_price_model,
    "homes_price_requests": q_homes_price_requests,
}

# ------------------------------------------------------------- DuckDB oracle

_STEPS = r"""p0 AS (SELECT * FROM homes WHERE home_id IS NOT NULL AND location IS NOT NULL AND size IS NOT NULL
  AND total_sqft IS NOT NULL AND bath IS NOT NULL AND price IS NOT NULL),
p1 AS (SELECT home_id, regexp_replace(location, '^\s+|\s+$', '', 'g') AS location, bath, price,
  TRY_CAST(split_part(size, ' ', 1) AS INTEGER) AS bhk,
  CASE WHEN len(string_split(total_sqft, '-')) = 2
       THEN (TRY_CAST(trim(string_split(total_sqft, '-')[1]) AS DOUBLE) + TRY_CAST(trim(string_split(total_sqft, '-')[2]) AS DOUBLE)) / 2
       ELSE TRY_CAST(trim(total_sqft) AS DOUBLE) END AS total_sqft FROM p0),
p2 AS (SELECT *, price * 100000 / total_sqft AS price_per_sqft FROM p1 WHERE total_sqft IS NOT NULL),
rare AS (SELECT p2.* REPLACE (CASE WHEN n <= 10 THEN 'other' ELSE p2.location END AS location)
  FROM p2 JOIN (SELECT location, count(*) AS n FROM p2 GROUP BY location) c ON p2.location = c.location),
area AS (SELECT * FROM rare WHERE coalesce(NOT (total_sqft / nullif(bhk, 0) < 300), TRUE)),
outl AS (SELECT a.* FROM area a JOIN (SELECT location, avg(price_per_sqft) AS m, stddev_pop(price_per_sqft) AS s
  FROM area GROUP BY location) g ON a.location = g.location
  WHERE a.price_per_sqft > g.m - g.s AND a.price_per_sqft <= g.m + g.s),
clean AS (SELECT home_id, location, bath, price, bhk, total_sqft FROM outl WHERE bath < bhk + 2)"""


def _q(sql, steps=_STEPS):
    body = V.with_views("SELECT 1", "homes")
    return body[: body.rindex("\nSELECT 1")] + f",\n{steps}\n{sql}"


# three coefficients by Cramer's rule over the sums of products within the locations
_PRICES = _STEPS + f""",
marked AS (SELECT *, substr(md5(concat('{MODEL_SEED}:', CAST(home_id AS VARCHAR))), 1, 8) < '33333333' AS held_out FROM clean),
taught AS (SELECT location, total_sqft AS x, bath AS y, CAST(bhk AS DOUBLE) AS z, price AS w FROM marked WHERE NOT held_out),
grouped AS (SELECT location, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(w) AS mw,
  covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz,
  covar_pop(z, z) AS zz, covar_pop(x, w) AS xw, covar_pop(y, w) AS yw, covar_pop(z, w) AS zw FROM taught GROUP BY location),
pooled AS (SELECT {", ".join(f"sum(n * {c}) AS {c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz", "xw", "yw", "zw"))} FROM grouped),
det AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS dt FROM pooled),
coef AS (SELECT (xw * (yy * zz - yz * yz) - xy * (yw * zz - yz * zw) + xz * (yw * yz - yy * zw)) / dt AS bx,
  (xx * (yw * zz - yz * zw) - xw * (xy * zz - yz * xz) + xz * (xy * zw - yw * xz)) / dt AS by_,
  (xx * (yy * zw - yw * yz) - xy * (xy * zw - yw * xz) + xw * (xy * yz - yy * xz)) / dt AS bz FROM det),
level AS (SELECT location, n, mw - bx * mx - by_ * my - bz * mz AS a FROM grouped, coef),
spare AS (SELECT coalesce(max(CASE WHEN location = 'other' THEN a END), sum(n * a) / sum(n)) AS a0 FROM level)"""
_PRICED = "round(coalesce(a, a0) + bx * total_sqft + by_ * bath + bz * bhk, 2) AS predicted_price"

_COLS = "home_id, location, bhk, total_sqft, bath, price, round(price_per_sqft, 6) AS price_per_sqft"

ORACLE = {
    "homes_features": _q(f"""SELECT {_COLS} FROM p2
        WHERE coalesce(NOT (total_sqft / nullif(bhk, 0) < 300), TRUE) AND bath < bhk + 2"""),
    "homes_rare_location": _q("SELECT home_id, location FROM rare"),
    "homes_outliers": _q(f"SELECT {_COLS} FROM outl"),
    "homes_one_hot": _q("""SELECT home_id, location AS dummy_column, 1.0::DOUBLE AS dummy_value FROM clean
        WHERE location <> (SELECT min(location) FROM clean)"""),
    "homes_numeric_share": V.with_views(
        """SELECT count(*) AS n_rows, count(CASE WHEN TRY_CAST(trim(total_sqft) AS DOUBLE) IS NOT NULL THEN 1 END) AS n_numeric,
             round(count(CASE WHEN TRY_CAST(trim(total_sqft) AS DOUBLE) IS NOT NULL THEN 1 END) / count(*), 6) AS share
           FROM homes""", "homes"),
    "homes_locations": _q("""SELECT DISTINCT location FROM clean WHERE location <> (SELECT min(location) FROM clean)
        ORDER BY location"""),
    "homes_price_model": _q(f"""SELECT home_id, m.location, price, {_PRICED}
        FROM marked m LEFT JOIN level v ON m.location = v.location, coef, spare WHERE held_out""", _PRICES),
    "homes_price_requests": _q(f"""SELECT home_id, r.location, total_sqft, bath, bhk, {_PRICED}
        FROM p2 r LEFT JOIN level v ON r.location = v.location, coef, spare""", _PRICES),
}
