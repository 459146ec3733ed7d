"""Writing panels and results: CSV at the edges, Parquet inside."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.options(header=True, nullValue="NA")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def read_csv_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result written by ``write_csv``, with the schema it had."""
    return spark.read.schema(schema).options(header=True, nullValue="NA").csv(path)


def by_scenario(
    df: DataFrame, files_per_scenario: int | None = None, day: str = "step"
) -> DataFrame:
    """Lay rows out for one folder per scenario, whole flocks together and in day order.

    The flocks of a scenario are spread over as many tasks as a shuffle has, so one that
    holds a third of the data does not end in one task; small partitions are merged by
    adaptive execution. ``files_per_scenario`` sets a lower number.
    """
    spread = files_per_scenario or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.hash("simu_id"), F.lit(spread))
    return df.repartition("scenario", salt).sortWithinPartitions("scenario", "simu_id", day)


def write_counts_tree(counts: DataFrame, path: str, files_per_scenario: int | None = None) -> str:
    """CSV tree with one folder per scenario, as the simulation runs leave it."""
    return write_csv(by_scenario(counts, files_per_scenario), path, ["scenario"])


def write_panel(counts: DataFrame, path: str, files_per_scenario: int | None = None) -> str:
    """Parquet by scenario: scenario filters prune folders, flocks lie together."""
    by_scenario(counts, files_per_scenario).write.partitionBy("scenario").parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, day: str = "day") -> str:
    """Table bucketed by flock: flock windows and joins on it need no exchange."""
    (
        df.write.mode("overwrite").bucketBy(buckets, "scenario", "simu_id")
        .sortBy("scenario", "simu_id", day)
        .option("path", path)
        .saveAsTable(table)
    )
    return table


def bucketed(df: DataFrame, path: str, buckets: int, day: str = "day") -> DataFrame:
    """Rows written to ``path`` by flock, as a frame that knows so; no table stays in the catalog."""
    table = save_bucketed(df, f"bucketed_{uuid.uuid4().hex}", path, buckets, day)
    return _taken(df.sparkSession, table)


def read_bucketed(spark: SparkSession, schema: T.StructType, path: str, buckets: int, day: str = "day") -> DataFrame:
    """What ``bucketed`` wrote, also after its folder was moved."""
    table = f"bucketed_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}) USING parquet "
        f"CLUSTERED BY (scenario, simu_id) SORTED BY (scenario, simu_id, {day}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return _taken(spark, table)


def _taken(spark: SparkSession, table: str) -> DataFrame:
    """A table's frame; its name goes, its files stay."""
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


class Publication:
    """Result tables of one run date that are published together.

    Results are written to a staging folder. ``publish`` first writes a manifest of what is to be moved and
    then moves it over the results of that date. A run that ends before the manifest leaves the old results as they are; one that
    ends after it is completed by the next run or by ``recover``. So the tables of a date are always of one run.
    Renames are done by the file system of the output folder; no row is copied.
    """

    def __init__(self, spark: SparkSession, output_dir: str, run_date: str) -> None:
        self.spark, self.output_dir, self.run_date = spark, output_dir.rstrip("/"), run_date
        self.files = _Files(spark, output_dir)
        self.part = f"run_date={run_date}"
        self.staging = f"{self.output_dir}/_staging/{self.part}"
        recover(spark, output_dir)
        self.files.delete(self.staging)

    def staged(self, name: str) -> str:
        """Where to write a table that will be called ``name``."""
        return f"{self.staging}/{name}"

    def publish(self, names: list[str]) -> None:
        """Everything that is staged under the names replaces the results of the run date."""
        absent = [n for n in names if not self.files.exists(f"{self.staged(n)}/{self.part}")]
        if absent:
            raise ValueError(f"not written: {', '.join(absent)}")
        moves = [[f"{self.staged(n)}/{self.part}", f"{self.output_dir}/{n}/{self.part}"] for n in names]
        self.files.write(_manifest(self.output_dir, self.run_date), json.dumps({"moves": moves, "staging": self.staging}))
        recover(self.spark, self.output_dir)


def _manifest(output_dir: str, run_date: str) -> str:
    return f"{output_dir.rstrip('/')}/_publishing/{run_date}.json"


def recover(spark: SparkSession, output_dir: str) -> list[str]:
    """Complete the publications that were begun in a folder; the run dates that were completed."""
    files, done = _Files(spark, output_dir), []
    for manifest in files.list(f"{output_dir.rstrip('/')}/_publishing", ".json"):
        begun = json.loads(files.read(manifest))
        for source, target in begun["moves"]:
            if files.exists(source):  # else it was moved before
                files.delete(target)
                files.rename(source, target)
        files.delete(begun["staging"])
        files.delete(manifest)
        done.append(manifest.rsplit("/", 1)[1].removesuffix(".json"))
    return done


class _Files:
    """The few operations that a publication needs of the file system that holds a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.java = spark.sparkContext._jvm
        self.system = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.java.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)

    def rename(self, source: str, target: str) -> None:
        self.system.mkdirs(self._path(target).getParent())
        if not self.system.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def list(self, folder: str, ending: str) -> list[str]:
        found = self.system.listStatus(self._path(folder)) if self.exists(folder) else []
        return sorted(f.getPath().toString() for f in found if f.getPath().toString().endswith(ending))

    def read(self, path: str) -> str:
        stream = self.system.open(self._path(path))
        try:
            return self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        stream = self.system.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.delete(path)
        self.rename(part, path)


def write_result(
    df: DataFrame, path: str, run_date: str, fmt: str = "parquet", by: list[str] | None = None
) -> str:
    """A result under its run date; runs of other dates in ``path`` stay as they are."""
    dated = df.withColumn("run_date", F.lit(run_date).cast("date"))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.options(header=True, nullValue="NA")
    writer.format(fmt).partitionBy("run_date", *(by or [])).save(path)
    return path


def read_result(
    spark: SparkSession, path: str, run_date: str, fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("run_date", T.DateType())]))
    if fmt == "csv":
        reader = reader.options(header=True, nullValue="NA")
    return reader.load(path).filter(F.col("run_date") == F.lit(run_date).cast("date"))
