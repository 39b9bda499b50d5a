"""File sources and sinks: CSV with a declared schema, whole-text
documents, overwrite and append sinks."""

from __future__ import annotations

import uuid
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orchard.session import scratch_path


NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of a null


class SourceMissing(FileNotFoundError):
    pass


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """CSV with a declared schema (no inference pass); a missing path is
    reported as ``SourceMissing`` at the pipeline edge."""
    try:
        df = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)
        df.schema  # resolves the path now
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise SourceMissing(path) from e
        raise


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """One text file per document under ``<path>/<id_col>=<id>/``, laid out as the partitioned text
    sink does (a line end after each text; rows of one id in one task share a file), but written by
    the tasks through ``pyarrow.fs``: the sink's committer moves every file once more, in the driver.
    A file gets its name when it is whole, so a retried task only replaces equal files."""
    drop_path(df.sparkSession, path)
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit(NULL_PARTITION)).alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("key"))
    rows = rows.sortWithinPartitions("key").select("id", "text")

    def write(batches):
        from pyspark import TaskContext
        fs, base = pafs.FileSystem.from_uri(path)
        part, n = TaskContext.get().partitionId(), 0
        texts = ((i, t) for b in batches for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True))
        for doc, same in groupby(texts, key=lambda r: r[0]):
            folder = f"{base}/{id_col}={quote(doc, safe=' ') if doc else NULL_PARTITION}"
            fs.create_dir(folder, recursive=True)
            name = f"{folder}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as out:
                for _, t in same:
                    out.write((t or "").encode() + b"\n")
            fs.move(name, f"{folder}/part-{part:05d}.txt")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_documents(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(id, path, text): every file read whole; the line end the text sink
    adds after each document is removed."""
    raw = spark.read.text(path, wholetext=True)
    v = F.col("value")
    text = F.when(v.endswith("\n"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(v)
    return raw.select(F.col(id_col), F.input_file_name().alias("path"), text.alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back, for tables that are read
    more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (any Hadoop scheme)."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def drop_path(spark: SparkSession, path: str) -> bool:
    """Remove a written table / collection folder (``DROP ... IF EXISTS``)."""
    fs, p = _fs_path(spark, path)
    return bool(fs.delete(p, True)) if fs.exists(p) else False
