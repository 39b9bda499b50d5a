"""Housing register clean-up: date standardisation, address fill from
sibling parcels, address splitting, flag recoding and the duplicate report.

Statements of the original script run in order against one mutable table;
here every step is a function returning a new DataFrame, and the steps are
chained in the same order (``cleaned``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.functions.text import after_first, before_first, part_from_right, recode
from orchard.operators.clean import fill_from_siblings, fill_preview
from orchard.operators.ranking import first_copies, split_row_number
from orchard.sources import views as V

DUP_KEYS = ["parcelid", "propertyaddress", "saleprice", "saledate", "legalreference"]
# fixed values: the Y/N flag spelled out
SOLD_FLAG = {"Y": "Yes", "N": "No"}


def standardise_date(h: DataFrame) -> DataFrame:
    return h.withColumn("saledate2", F.to_date("saledate"))


def fill_address(h: DataFrame) -> DataFrame:
    return fill_from_siblings(h, "parcelid", "propertyaddress", "uniqueid")


def split_property(h: DataFrame) -> DataFrame:
    a = F.col("propertyaddress")
    return (h.withColumn("propertysplitaddress", before_first(a))
            .withColumn("propertysplitcity", after_first(a)))


def split_owner(h: DataFrame) -> DataFrame:
    a = F.col("owneraddress")
    return (h.withColumn("ownersplitaddress", part_from_right(a, 3))
            .withColumn("ownersplitcity", part_from_right(a, 2))
            .withColumn("ownersplitstate", part_from_right(a, 1)))


def recode_sold(h: DataFrame) -> DataFrame:
    return h.withColumn("soldasvacant", recode(F.col("soldasvacant"), SOLD_FLAG))


def cleaned(h: DataFrame) -> DataFrame:
    """All update steps in script order, before the final column drop."""
    return recode_sold(split_owner(split_property(fill_address(standardise_date(h)))))


def dropped(h: DataFrame) -> DataFrame:
    return h.drop("saledate", "owneraddress", "taxdistrict", "propertyaddress")


def surplus_copies(h: DataFrame) -> DataFrame:
    """Rows after the first of every 5-key group (row_num > 1)."""
    return split_row_number(h, DUP_KEYS, "uniqueid", "row_num").where(F.col("row_num") > 1)


# ------------------------------------------------------------------ queries

def q_housing_sale_date(spark, d):
    return standardise_date(V.housing(spark, d)).select("uniqueid", "saledate2")


def q_housing_fill_preview(spark, d):
    return fill_preview(V.housing(spark, d), "parcelid", "propertyaddress", "uniqueid")


def q_housing_fill_address(spark, d):
    return fill_address(V.housing(spark, d)).select("uniqueid", "parcelid", "propertyaddress")


def q_housing_split_property(spark, d):
    return split_property(fill_address(V.housing(spark, d))).select(
        "uniqueid", "propertysplitaddress", "propertysplitcity")


def q_housing_split_owner(spark, d):
    return split_owner(V.housing(spark, d)).select(
        "uniqueid", "ownersplitaddress", "ownersplitcity", "ownersplitstate")


def q_housing_flag_counts(spark, d):
    h = V.housing(spark, d)
    return (h.groupBy("soldasvacant").agg(F.count("soldasvacant").alias("n"))
            .orderBy("n", "soldasvacant"))


def q_housing_sold_flag(spark, d):
    h = V.housing(spark, d)
    return h.select("uniqueid", "soldasvacant",
                    recode(F.col("soldasvacant"), SOLD_FLAG).alias("soldasvacant_fixed"))


def _dup_input(spark, d):
    return cleaned(V.housing(spark, d)).select(
        "uniqueid", "parcelid", "propertyaddress", "saleprice", F.to_date("saledate").alias("saledate"),
        "legalreference")


def q_housing_duplicates(spark, d):
    return surplus_copies(_dup_input(spark, d)).orderBy("propertyaddress")


def q_housing_dedup(spark, d):
    return first_copies(_dup_input(spark, d), DUP_KEYS, "uniqueid")


def q_housing_clean(spark, d):
    return dropped(cleaned(V.housing(spark, d)))


QUERIES = {
    "housing_sale_date": q_housing_sale_date,
    "housing_fill_preview": q_housing_fill_preview,
    "housing_fill_address": q_housing_fill_address,
    "housing_split_property": q_housing_split_property,
    "housing_split_owner": q_housing_split_owner,
    "housing_flag_counts": q_housing_flag_counts,
    "housing_sold_flag": q_housing_sold_flag,
    "housing_duplicates": q_housing_duplicates,
    "housing_dedup": q_housing_dedup,
    "housing_clean": q_housing_clean,
}

# ------------------------------------------------------------- DuckDB oracle

_DONORS = """donors AS (SELECT parcelid, arg_min(propertyaddress, uniqueid) AS fill, count(*) AS n_rows
  FROM housing GROUP BY parcelid),
nn AS (SELECT parcelid, arg_min(propertyaddress, uniqueid) AS fill FROM housing
  WHERE propertyaddress IS NOT NULL GROUP BY parcelid),
filled AS (SELECT h.* REPLACE (coalesce(h.propertyaddress, nn.fill) AS propertyaddress)
  FROM housing h LEFT JOIN nn ON h.parcelid = nn.parcelid)"""


def _part(col: str, n: int) -> str:
    lst = f"string_split(replace({col}, ',', '.'), '.')"
    return (f"CASE WHEN len({lst}) <= 4 AND len({lst}) >= {n} "
            f"THEN nullif({lst}[len({lst}) - {n} + 1], '') END")


_PROP_ADDR = "CASE WHEN instr(propertyaddress, ',') > 0 THEN split_part(propertyaddress, ',', 1) END"
_PROP_CITY = "substr(propertyaddress, instr(propertyaddress, ',') + 1)"
_SOLD = "CASE WHEN soldasvacant = 'Y' THEN 'Yes' WHEN soldasvacant = 'N' THEN 'No' ELSE soldasvacant END"


def _h(sql: str) -> str:
    body = V.with_views("SELECT 1", "housing")
    head = body[: body.rindex("\nSELECT 1")]
    return f"{head},\n{_DONORS}\n{sql}"


_DUP_IN = """dup_in AS (SELECT uniqueid, parcelid, propertyaddress, saleprice, CAST(saledate AS DATE) AS saledate,
  legalreference FROM filled),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY parcelid, propertyaddress, saleprice, saledate, legalreference
  ORDER BY uniqueid) AS INTEGER) AS row_num FROM dup_in)"""

ORACLE = {
    "housing_sale_date": V.with_views("SELECT uniqueid, CAST(saledate AS DATE) AS saledate2 FROM housing", "housing"),
    "housing_fill_preview": _h(
        """SELECT h.uniqueid, h.parcelid, h.propertyaddress, nn.fill AS fill_propertyaddress,
             d.n_rows - 1 AS sibling_count
           FROM housing h JOIN donors d ON h.parcelid = d.parcelid LEFT JOIN nn ON h.parcelid = nn.parcelid
           WHERE h.propertyaddress IS NULL AND d.n_rows > 1"""),
    "housing_fill_address": _h("SELECT uniqueid, parcelid, propertyaddress FROM filled"),
    "housing_split_property": _h(
        f"SELECT uniqueid, {_PROP_ADDR} AS propertysplitaddress, {_PROP_CITY} AS propertysplitcity FROM filled"),
    "housing_split_owner": V.with_views(
        f"""SELECT uniqueid, {_part('owneraddress', 3)} AS ownersplitaddress, {_part('owneraddress', 2)} AS ownersplitcity,
            {_part('owneraddress', 1)} AS ownersplitstate FROM housing""", "housing"),
    "housing_flag_counts": V.with_views(
        "SELECT soldasvacant, count(soldasvacant) AS n FROM housing GROUP BY soldasvacant ORDER BY 2", "housing"),
    "housing_sold_flag": V.with_views(
        f"SELECT uniqueid, soldasvacant, {_SOLD} AS soldasvacant_fixed FROM housing", "housing"),
    "housing_duplicates": _h(f"""SELECT * FROM (WITH {_DUP_IN}
        SELECT * FROM ranked WHERE row_num > 1) x ORDER BY propertyaddress"""),
    "housing_dedup": _h(f"""SELECT uniqueid, parcelid, propertyaddress, saleprice, saledate, legalreference FROM (
        WITH {_DUP_IN} SELECT * FROM ranked WHERE row_num = 1) x"""),
    "housing_clean": _h(
        f"""SELECT uniqueid, parcelid, saleprice, legalreference, {_SOLD} AS soldasvacant,
             CAST(saledate AS DATE) AS saledate2, {_PROP_ADDR} AS propertysplitaddress,
             {_PROP_CITY} AS propertysplitcity, {_part('owneraddress', 3)} AS ownersplitaddress,
             {_part('owneraddress', 2)} AS ownersplitcity, {_part('owneraddress', 1)} AS ownersplitstate
           FROM filled"""),
}
