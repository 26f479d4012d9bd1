"""Sinks for micro-batches. A batch that is written again after a failure leaves the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.alerts import latest_by

Batch = Callable[[DataFrame, int], None]


def to_kafka(df: DataFrame, servers: str, topic: str, key: str = "insured_id") -> DataStreamWriter:
    """Rows as JSON, keyed so that a user's alerts stay in order."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def append_once(path: str) -> Batch:
    """Append each batch under its own number; the same batch again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def split_dead_letters(good_path: str, dead_path: str, parse) -> Batch:
    """``parse(batch)`` gives events and dead letters; each goes to its own table."""
    good_once, dead_once = append_once(good_path), append_once(dead_path)

    def write(batch: DataFrame, number: int) -> None:
        good, dead = parse(batch)
        good_once(good, number)
        dead_once(dead.withColumn("processed_at", F.current_timestamp()), number)

    return write


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The current rows of a table that ``append_once`` wrote: the newest of each key, the later batch among equals."""
    return latest_by(df, keys, order, "batch")


class LatestTable:
    """A table with one row a key, the newest, kept up by micro-batches; a batch that is written again leaves it as it is.

    Keys are dealt into ``buckets``. A batch rewrites the buckets that it touches, below ``batch=<number>``, from those that
    earlier batches left, and is there for readers once its list of buckets is written, in one file. What a batch left
    unfinished is never read and is replaced when it comes again.
    """

    def __init__(self, path: str, keys: list[str], order: str, buckets: int = 64) -> None:
        self.path, self.keys, self.order, self.buckets = path, keys, order, buckets

    def _versions(self, spark, before: int | None = None) -> dict[int, int]:
        """The batch that holds each bucket: at most as many rows as there are buckets."""
        try:
            lists = spark.read.schema("bucket int").option("basePath", f"{self.path}/lists").json(f"{self.path}/lists")
        except AnalysisException:
            return {}
        if "batch" not in lists.columns:
            return {}
        known = lists if before is None else lists.where(F.col("batch") < before)
        return {r.bucket: r.batch for r in known.where("bucket is not null").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _read(self, spark, versions: dict[int, int], schema) -> DataFrame | None:
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in versions.items():
            by_batch.setdefault(batch, []).append(bucket)
        out = None
        for batch, own in by_batch.items():
            reader = spark.read.option("basePath", f"{self.path}/rows/batch={batch}")
            rows = (reader.schema(schema) if schema is not None else reader).parquet(*(f"{self.path}/rows/batch={batch}/bucket={b}" for b in sorted(own)))
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, spark) -> DataFrame | None:
        """The rows of the table; None before the first batch."""
        rows = self._read(spark, self._versions(spark), None)
        return None if rows is None else rows.drop("bucket")

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``. Of rows of a key that are equally new, the later batch's stands."""
        spark = batch.sparkSession
        new = latest_by(batch, self.keys, self.order).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        new = new.persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
            if touched:
                versions = self._versions(spark, number)
                old = self._read(spark, {b: versions[b] for b in touched if b in versions}, new.schema)
                rows = new.withColumn("_new", F.lit(1))
                if old is not None:
                    rows = latest_by(rows.unionByName(old.withColumn("_new", F.lit(0))), self.keys, self.order, "_new")
                rows.drop("_new").repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
                listed = spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
                listed.write.mode("overwrite").json(f"{self.path}/lists/batch={number}")
        finally:
            new.unpersist()

    def vacuum(self, spark) -> int:
        """Delete what no bucket is read from any more, but for the last two batches'; returns the number of batches that went. Only while no reader is at work."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/rows")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        have = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(root) if x.getPath().getName().startswith("batch="))
        used = set(self._versions(spark).values())
        gone = [b for b in have[:-2] if b not in used]
        for b in gone:
            fs.delete(hadoop(f"{self.path}/rows/batch={b}"), True)
            fs.delete(hadoop(f"{self.path}/lists/batch={b}"), True)
        return len(gone)


def source_lag(progress: dict) -> int:
    """Records that a stream's Kafka sources have not read yet, from a query's last progress; never negative for a partition."""
    import json

    def offsets(x) -> dict:
        return json.loads(x) if isinstance(x, str) else x or {}

    lag = 0
    for source in progress.get("sources", []):
        latest = offsets(source.get("latestOffset"))
        for topic, read in offsets(source.get("endOffset")).items():
            lag += sum(max(0, latest.get(topic, {}).get(part, at) - at) for part, at in read.items())
    return lag
