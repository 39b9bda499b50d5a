"""Input views of the analytics workflows, derived from the base tables.

The workflows were written against inputs that do not ship with them
(census rates and counts, a housing register, card transactions, ...).
Each function here derives the stand-in for one such input from the
provided tables, lazily, with the DataFrame API, so that every query's work
grows with the tables.  ``VIEW_SQL`` holds the same definitions as DuckDB
SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.sources.tables import table


def _s(c: Column) -> Column:
    return c.cast("string")


def census_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("district"),
        F.concat(F.lit("State"), F.lpad(_s(F.col("c_nationkey")), 2, "0")).alias("state"),
        ((key % 37).cast("double") / 100).alias("growth"),
        (F.lit(850) + key % 200).cast("double").alias("sex_ratio"),
        ((F.lit(500) + (key * 7919) % 480).cast("double") / 10).alias("literacy"),
    )


def census_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("district"),
        (F.lit(10) + key % 900).cast("double").alias("area_km2"),
        (F.lit(1000) + (key * 104729) % 900000).cast("bigint").alias("population"),
    )


def housing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    parcel = _s(ck % 400)
    return o.select(
        ok.alias("uniqueid"),
        F.concat(F.lit("P"), parcel).alias("parcelid"),
        F.when(ok % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(parcel, F.lit(" MAIN ST, CITY"), _s(ck % 7))).alias("propertyaddress"),
        F.when(ok % 11 == 0, F.lit("NO COMMAS"))
        .otherwise(F.concat(_s(ck), F.lit(" OAK AVE, CITY"), _s(ck % 7), F.lit(", TN"))).alias("owneraddress"),
        F.date_trunc("year", F.col("o_orderdate")).alias("saledate"),
        ((ck % 400) * 1000).cast("bigint").alias("saleprice"),
        F.concat(F.lit("L"), parcel).alias("legalreference"),
        F.when(F.col("o_orderstatus") == "P", "Y")
        .when(F.col("o_orderstatus") == "F", "N").otherwise("Yes").alias("soldasvacant"),
        F.col("o_orderpriority").alias("taxdistrict"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ok.alias("txn_id"),
        ((ck % 13).cast("double") - 6).alias("v1"),
        ((ok % 17).cast("double") - 8).alias("v2"),
        F.col("o_totalprice").alias("amount"),
        F.when(ok % 97 == 0, 1).otherwise(0).alias("class"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    return o.select(
        ok.alias("movie_id"),
        F.concat(F.lit("June 13, "), _s(F.year("o_orderdate")), F.lit(" (Country)")).alias("released"),
        F.col("o_orderpriority").alias("company"),
        F.when(ok % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("budget"),
        (F.col("o_totalprice") * (1 + (ok % 13).cast("double") / 10)).alias("gross"),
        F.col("o_custkey").cast("double").alias("votes"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    # region is a five-row dimension: a broadcast hash join without a shuffle
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"),
        (F.lit(1000) + k * 37).cast("bigint").alias("p1970"),
        (F.lit(2000) + k * 41).cast("bigint").alias("p2000"),
        (F.lit(3000) + (k * 53) % 700).cast("bigint").alias("p2022"),
    )


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m20 = k % 20
    return p.select(
        k.alias("home_id"),
        F.when(k % 211 == 0, F.concat(F.lit("Rare"), _s(k % 5)))
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("location"),
        F.concat(_s(1 + F.col("p_size") % 5), F.lit(" BHK")).alias("size"),
        F.when(m20 == 0, F.lit("1000 - 1400")).when(m20 == 1, F.lit("34.46Sq. Meter"))
        .when(m20 == 2, F.lit(None).cast("string")).otherwise(_s(600 + k % 2000)).alias("total_sqft"),
        (1 + k % 6).cast("double").alias("bath"),
        (F.col("p_retailprice") / 10).alias("price"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (1 + F.col("doc_id") % 5).cast("int").alias("score"),
        F.col("text"),
        F.col("quality"),
        F.col("toxic"),
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of every review, without its labels: to join them would move the texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


PARTY_BY_SEGMENT = [("BUILDING", "DMK"), ("MACHINERY", "AIADMK"), ("HOUSEHOLD", "BJP"), ("FURNITURE", "IND")]
PARTY_BY_EVENT = [("view", "DMK"), ("click", "AIADMK"), ("signup", "TVK"), ("error", "bjp")]


def _case(col: Column, pairs, default: str) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


def vote_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return (
        c.select((1 + k % 234).alias("constituency_no"),
                 _case(F.col("c_mktsegment"), PARTY_BY_SEGMENT, "NTK").alias("party"),
                 (k % 41).alias("s16"), (k % 53).alias("s21"), (k % 2).alias("w21"))
        .groupBy("constituency_no", "party")
        .agg(F.max("s16").cast("double").alias("vote_share_2016"),
             F.max("s21").cast("double").alias("vote_share_2021"),
             (F.max("w21") == 1).alias("winner_2021"))
    )


def sentiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    m4 = eid % 4
    return e.select(
        (1 + (F.col("user_id") * 7 + eid) % 234).alias("constituency_no"),
        _case(F.col("event_type"), PARTY_BY_EVENT, "CONGRESS").alias("party"),
        F.when(m4 == 0, "Positive").when(m4 == 1, "Neutral").when(m4 == 2, "Negative")
        .otherwise("Mixed").alias("sentiment"),
    )


def price_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily snapshots of every page (days 0..2 after 2024-01-01): the whole page, its
    heading and a price block marked by ids, the price being the url's number plus the day."""
    p = table(spark, sf_dir, "pages")
    d = F.col("d")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INT)") + d
    price = F.coalesce(F.concat(F.lit("Rs. "), _s(number), F.lit(".00")), F.lit("on request"))
    block = F.concat(F.lit('<div id="apex_desktop"><div>Price</div><span>  '), price, F.lit(" </span></div></article>"))
    marked = F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 id="productTitle">')), F.lit("</article>"), block)
    return (
        p.select("page_id", "url", "html", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("d"))
        .select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), d).alias("seen_on"), marked.alias("html"))
    )


def constituency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    no = 1 + F.col("c_custkey") % 234
    return c.select(no.alias("constituency_no"),
                    F.concat(F.lit("SEAT "), _s(no % 230)).alias("constituency_name")).distinct()


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word): lower-case letter runs of every document."""
    from orchard.sources.tables import spread
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
                    .alias("pos", "word"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, valence): the scoring lexicon, derived from the corpus words."""
    t = tokens(spark, sf_dir)
    return (t.where(F.length("word") % 3 == 0).select("word").distinct()
            .select("word", (F.length("word") % 9 - 4).cast("double").alias("valence")))


VIEWS = {
    "census_rates": census_rates, "census_counts": census_counts, "housing": housing,
    "transactions": transactions, "movies": movies, "population": population, "homes": homes,
    "reviews": reviews, "vote_history": vote_history, "sentiment_rows": sentiment_rows,
    "price_snapshots": price_snapshots, "constituency_lookup": constituency_lookup,
    "tokens": tokens, "lexicon": lexicon,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


# --- DuckDB twins (oracle side) -------------------------------------------

VIEW_SQL = {
    "census_rates": """SELECT c_custkey AS district, concat('State', lpad(CAST(c_nationkey AS VARCHAR),2,'0')) AS state,
  CAST(c_custkey % 37 AS DOUBLE)/100 AS growth, CAST(850 + c_custkey % 200 AS DOUBLE) AS sex_ratio,
  CAST(500 + (c_custkey*7919) % 480 AS DOUBLE)/10 AS literacy FROM customer""",
    "census_counts": """SELECT c_custkey AS district, CAST(10 + c_custkey % 900 AS DOUBLE) AS area_km2,
  CAST(1000 + (c_custkey*104729) % 900000 AS BIGINT) AS population FROM customer""",
    "housing": """SELECT o_orderkey AS uniqueid, concat('P', CAST(o_custkey % 400 AS VARCHAR)) AS parcelid,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(CAST(o_custkey % 400 AS VARCHAR),' MAIN ST, CITY',CAST(o_custkey % 7 AS VARCHAR)) END AS propertyaddress,
  CASE WHEN o_orderkey % 11 = 0 THEN 'NO COMMAS' ELSE concat(CAST(o_custkey AS VARCHAR),' OAK AVE, CITY',CAST(o_custkey % 7 AS VARCHAR),', TN') END AS owneraddress,
  date_trunc('year', o_orderdate) AS saledate, CAST((o_custkey % 400)*1000 AS BIGINT) AS saleprice,
  concat('L', CAST(o_custkey % 400 AS VARCHAR)) AS legalreference,
  CASE o_orderstatus WHEN 'P' THEN 'Y' WHEN 'F' THEN 'N' ELSE 'Yes' END AS soldasvacant, o_orderpriority AS taxdistrict FROM orders""",
    "transactions": """SELECT o_orderkey AS txn_id, CAST(o_custkey % 13 AS DOUBLE) - 6 AS v1, CAST(o_orderkey % 17 AS DOUBLE) - 8 AS v2,
  o_totalprice AS amount, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS class FROM orders""",
    "movies": """SELECT o_orderkey AS movie_id, concat('June 13, ', CAST(year(o_orderdate) AS VARCHAR), ' (Country)') AS released,
  o_orderpriority AS company, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS budget,
  o_totalprice * (1 + CAST(o_orderkey % 13 AS DOUBLE)/10) AS gross, CAST(o_custkey AS DOUBLE) AS votes FROM orders""",
    "population": """SELECT n_name AS country, r_name AS continent, CAST(1000 + n_nationkey*37 AS BIGINT) AS p1970,
  CAST(2000 + n_nationkey*41 AS BIGINT) AS p2000, CAST(3000 + (n_nationkey*53) % 700 AS BIGINT) AS p2022
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "homes": """SELECT p_partkey AS home_id, CASE WHEN p_partkey % 211 = 0 THEN concat('Rare', CAST(p_partkey % 5 AS VARCHAR)) ELSE concat(' ', p_name, ' ') END AS location,
  concat(CAST(1 + p_size % 5 AS VARCHAR), ' BHK') AS size,
  CASE p_partkey % 20 WHEN 0 THEN '1000 - 1400' WHEN 1 THEN '34.46Sq. Meter' WHEN 2 THEN NULL ELSE CAST(600 + p_partkey % 2000 AS VARCHAR) END AS total_sqft,
  CAST(1 + p_partkey % 6 AS DOUBLE) AS bath, p_retailprice/10 AS price FROM part""",
    "reviews": """SELECT d.doc_id AS id, CAST(1 + d.doc_id % 5 AS INT) AS score, d.text AS text, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "vote_history": """SELECT 1 + c_custkey % 234 AS constituency_no,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'DMK' WHEN 'MACHINERY' THEN 'AIADMK' WHEN 'HOUSEHOLD' THEN 'BJP' WHEN 'FURNITURE' THEN 'IND' ELSE 'NTK' END AS party,
  CAST(max(c_custkey % 41) AS DOUBLE) AS vote_share_2016, CAST(max(c_custkey % 53) AS DOUBLE) AS vote_share_2021,
  max(c_custkey % 2) = 1 AS winner_2021 FROM customer GROUP BY 1, 2""",
    "sentiment_rows": """SELECT 1 + (user_id*7 + event_id) % 234 AS constituency_no,
  CASE event_type WHEN 'view' THEN 'DMK' WHEN 'click' THEN 'AIADMK' WHEN 'signup' THEN 'TVK' WHEN 'error' THEN 'bjp' ELSE 'CONGRESS' END AS party,
  CASE event_id % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Negative' ELSE 'Mixed' END AS sentiment FROM events""",
    "price_snapshots": """SELECT page_id, url, DATE '2024-01-01' + CAST(d AS INT) AS seen_on,
  replace(replace(html, '<h1>', '<h1 id="productTitle">'), '</article>', concat('<div id="apex_desktop"><div>Price</div><span>  ',
    coalesce('Rs. ' || CAST(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INT) + d AS VARCHAR) || '.00', 'on request'), ' </span></div></article>')) AS html
  FROM pages CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
    "constituency_lookup": """SELECT DISTINCT 1 + c_custkey % 234 AS constituency_no, concat('SEAT ', CAST((1 + c_custkey % 234) % 230 AS VARCHAR)) AS constituency_name FROM customer""",
    "tokens": """SELECT doc_id, CAST(generate_subscripts(w,1)-1 AS INT) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') w FROM documents) t""",
    "lexicon": """SELECT DISTINCT word, CAST(length(word) % 9 - 4 AS DOUBLE) AS valence FROM tokens WHERE length(word) % 3 = 0""",
}

_VIEW_DEPS = {"lexicon": ["tokens"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs defining the named views (DuckDB)."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _VIEW_DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in order)
    return f"WITH {ctes}\n{sql}"
