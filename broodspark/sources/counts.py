"""Reading counts tables: CSV trees with one folder per scenario, single files, Parquet."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodspark.functions.small import broadcast_if_small
from broodspark.schema import COUNTS_SCHEMA, REQUIRED_COUNTS

CSV_OPTIONS = {
    "header": True,
    "nullValue": "NA",
    # Each file's header must be that of its group; a file that changes in between fails instead of being misread.
    "enforceSchema": False,
    "mode": "FAILFAST",
    "recursiveFileLookup": True,
}
# The folder of a file; a folder written as key=value stands for its value.
FOLDER = r"/(?:[^/=]+=)?([^/=]+)/[^/]+$"


def folder_of(path: Column | str = "_metadata.file_path") -> Column:
    """The folder of a file as it is named on disk; file paths of Spark are URL-encoded, a plus sign is not."""
    return F.url_decode(F.replace(F.regexp_extract(path, FOLDER, 1), F.lit("+"), F.lit("%2B")))


def file_headers(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> dict[str, tuple[str, ...]]:
    """The column names of every file below ``path``, by its path; files without a line are left out.

    Only the first line of a file is read. The driver has the listing anyway; it opens the files side by side.
    """
    listing = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    files = [unquote(uri) for uri in listing.inputFiles()]
    java, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    conf = context.hadoopConfiguration()
    codecs = java.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> str | None:
        place = java.org.apache.hadoop.fs.Path(file)
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = codecs.getCodec(place)
            source = codec.createInputStream(stream) if codec else stream
            return java.java.io.BufferedReader(java.java.io.InputStreamReader(source, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        lines = dict(zip(files, pool.map(first_line, files), strict=True))
    return {f: tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) for f, line in lines.items() if line}


def read_counts(
    spark: SparkSession,
    path: str | list[str],
    scenario: str | None = None,
    run_kind: str | None = None,
    pattern: str = "*.csv",
) -> DataFrame:
    """Scan every CSV below ``path`` as one table with a ``scenario`` column.

    The scenario is the name of the file's folder, or ``scenario`` if given (a healthy
    baseline, say). Columns go by their names: files may hold them in another order, and a column that a file
    lacks is NULL in its rows, unless it is one that the daily step needs. There is one scan per header.
    Types come from the counts schema; no data is read to infer them.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in file_headers(spark, path, pattern).items():
        groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError(f"{path} has no file {pattern} with a header")
    for header, files in groups.items():
        if missing := sorted(set(REQUIRED_COUNTS) - set(header)):
            raise ValueError(f"{min(files)} lacks the columns: {', '.join(missing)}")
        if len({c.lower() for c in header}) < len(header):
            raise ValueError(f"{min(files)} names a column twice")
    # Columns in the order of the first file.
    order = sorted(groups, key=lambda h: min(groups[h]))
    scans = [_scan(spark, h, path if len(groups) == 1 else [_literal(f) for f in groups[h]], scenario, pattern) for h in order]
    counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return counts.withColumn("run_kind", F.lit(run_kind)) if run_kind else counts


def _literal(path: str) -> str:
    """A path that stands for itself where patterns are allowed."""
    return re.sub(r"([\\{}\[\]*?^])", r"\\\1", path)


def _scan(spark: SparkSession, header: tuple[str, ...], path: str | list[str], scenario: str | None, pattern: str) -> DataFrame:
    known = {field.name: field.dataType for field in COUNTS_SCHEMA.fields}
    schema = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in header])
    reader = spark.read.schema(schema).options(**CSV_OPTIONS, pathGlobFilter=pattern)
    return reader.csv(path).select("*", (F.lit(scenario) if scenario else folder_of()).alias("scenario"))


def parent_of(path: str) -> str:
    return path.rsplit("/", 1)[0]


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """One row per file below ``path`` with its size and scenario folder; no file content is read."""
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=pattern)
        .load(path)
    )
    return files.select("path", "length", folder_of().alias("scenario"))


def file_count(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Files below ``path``, and the scenario folders that hold them."""
    return list_files(spark, path, pattern).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("scenario").alias("n_folders")
    )


def scenario_ordinals(files: DataFrame) -> DataFrame:
    """Running number per scenario folder in name order.

    One row per folder of a listing that the driver already holds, so one sort task is
    enough however large the files are.
    """
    folders = files.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_files"))
    return folders.withColumn("ordinal", F.dense_rank().over(Window.orderBy("scenario")))


def with_ordinal(counts: DataFrame, ordinals: DataFrame) -> DataFrame:
    numbers = ordinals.select("scenario", "ordinal")
    return counts.join(broadcast_if_small(numbers), "scenario", "left")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Counts stored as Parquet by scenario (``sinks.write_panel``); filters prune folders."""
    return spark.read.parquet(path).withColumn("scenario", F.col("scenario").cast("string"))
