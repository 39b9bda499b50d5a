"""Incremental price history.

Daily page snapshots land as files in a folder; a Structured Streaming job
turns each new file into price rows, drops repeats of the same page and day
within a two-day watermark, and appends to a Parquet history with a
checkpoint, so a rerun (or an executor loss) neither loses nor repeats rows.
The job is started by an outside scheduler once a day with
``trigger(availableNow=True)``: it processes what has landed and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.functions.html import with_element_text
from orchard.session import scratch_path

PRICE_PATTERN = r"([0-9][0-9,]*(\.[0-9]+)?)"


TITLE_ID, PRICE_ID = "productTitle", "apex_desktop"  # fixed values: ids of the elements read


def extract_prices(snapshots: DataFrame) -> DataFrame:
    """Page snapshot -> (page_id, url, seen_on, seen_at, title, price), from the elements of the
    page (``html``) or from texts cut out before (``title``, ``price_text``)."""
    if "html" in snapshots.columns:
        found = with_element_text(with_element_text(snapshots, "html", TITLE_ID, "title"), "html", PRICE_ID, "price_text")
        return _fields(found, F.trim("title"))
    return _fields(snapshots, F.trim(F.replace(F.col("title"), F.lit("&amp;"), F.lit("&"))))


def _fields(snapshots: DataFrame, title) -> DataFrame:
    raw = F.regexp_extract(F.col("price_text"), PRICE_PATTERN, 1)
    price = F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return snapshots.select("page_id", "url", "seen_on", F.col("seen_on").cast("timestamp").alias("seen_at"),
                            title.alias("title"), price.alias("price"))


def run_price_history(spark: SparkSession, landing: str, history: str, checkpoint: str,
                      schema, max_files: int = 1) -> None:
    """Process every snapshot file in ``landing`` that the checkpoint has
    not seen yet, appending to ``history``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    rows = (extract_prices(src).withWatermark("seen_at", "2 days")
            .dropDuplicatesWithinWatermark(["url", "seen_on"]))
    q = (rows.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(history))
    q.awaitTermination()


def land_by_day(snapshots: DataFrame, landing: str) -> int:
    """One drop per day, in order, as the daily job would receive them; each task writes its own
    part of a drop.  Returns the number of files of the largest drop."""
    days = [r[0] for r in snapshots.select("seen_on").distinct().orderBy("seen_on").collect()]
    for day in days:
        snapshots.where(F.col("seen_on") == F.lit(day)).write.mode("append").parquet(landing)
    if not days:
        return 1
    files = snapshots.sparkSession.read.schema(snapshots.schema).parquet(landing).select(
        "seen_on", F.input_file_name().alias("f")).distinct()
    return files.groupBy("seen_on").count().agg(F.max("count")).first()[0] or 1


def price_history(spark: SparkSession, snapshots: DataFrame) -> DataFrame:
    """Land ``snapshots`` day by day, run the stream, read the history."""
    base = scratch_path(spark, "price-history")
    landing, history, ckpt = f"{base}/landing", f"{base}/history", f"{base}/checkpoint"
    run_price_history(spark, landing, history, ckpt, snapshots.schema, land_by_day(snapshots, landing))
    return spark.read.parquet(history)


def daily_price_frame(prices: DataFrame) -> DataFrame:
    """Daily tumbling window per page: min, max, last price, snapshots."""
    return (prices.groupBy(F.window("seen_at", "1 day").alias("w"), "url")
            .agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"),
                 F.max_by("price", "seen_at").alias("last_price"), F.count(F.lit(1)).alias("n_snapshots")))


def run_daily_prices(spark: SparkSession, landing: str, out: str, checkpoint: str, schema,
                     max_files: int = 1) -> None:
    """Streaming daily windows in update mode.  Every micro-batch appends the
    windows it changed, tagged with its batch id; readers keep the latest
    version of each (url, day).  Re-running a batch after a failure appends
    the same rows with the same id, so the result does not change."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    agg = daily_price_frame(extract_prices(src).withWatermark("seen_at", "2 days"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_daily(spark: SparkSession, out: str) -> DataFrame:
    t = spark.read.parquet(out)
    best = F.max_by(F.struct("min_price", "max_price", "last_price", "n_snapshots"), F.col("_batch"))
    return (t.groupBy("url", F.col("w.start").alias("start")).agg(best.alias("_r"))
            .select("url", F.to_date("start").alias("day"), "_r.*"))


def daily_prices(spark: SparkSession, snapshots: DataFrame) -> DataFrame:
    """Land ``snapshots`` day by day, run the daily-window stream, read
    the latest window values."""
    base = scratch_path(spark, "price-daily")
    landing, out, ckpt = f"{base}/landing", f"{base}/windows", f"{base}/checkpoint"
    run_daily_prices(spark, landing, out, ckpt, snapshots.schema, land_by_day(snapshots, landing))
    return latest_daily(spark, out)
