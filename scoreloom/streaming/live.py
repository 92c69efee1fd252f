"""Run tables that grow: the same functions on streams.

Responses are written as they finish, so their folder is a file stream.  The transformations below
take streaming or batch DataFrames; only the two writers need a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.checks import run_checks, verdict
from scoreloom.operators.runs import latest


def stream_table(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def validate(texts: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Verdicts and issues before anything is stored; stateless."""
    return verdict(run_checks(texts, checks))


def _timed(df: DataFrame) -> DataFrame:
    """Streams need a timestamp with a time zone as event time."""
    return df.withColumn("received_at", F.col("received_at").cast("timestamp")) if df.isStreaming else df


def tokens_per_window(responses: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Token totals of all attempts per time window, with late rows up to the watermark."""
    window = F.window("received_at", size, slide) if slide else F.window("received_at", size)
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return (_timed(responses).withWatermark("received_at", late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *sums)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "prompt_tokens", "completion_tokens"))


def activity_sessions(responses: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of attempts: a session ends when nothing happens for ``gap``."""
    return (_timed(responses).withWatermark("received_at", late).groupBy(F.session_window("received_at", gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"))


def highest_attempts(responses: DataFrame) -> DataFrame:
    """The highest attempt of each request, whatever the order of arrival."""
    return latest(responses, ["request_id"], "attempt")


def start_latest(responses: DataFrame, root: str, checkpoint: str, compact_every: int = 100, **trigger):
    """Write the highest attempts of every micro-batch under ``root``; every ``compact_every`` batches what is there becomes one table.

    A batch costs what it brings, not what is there already; a batch that is repeated after a failure
    overwrites its own folder.  ``read_latest`` reads one table and the batches behind it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        highest_attempts(batch).write.mode("overwrite").parquet(f"{root}/batches/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, root, batch_id)

    return (responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Merge everything up to a batch into one table; a repeated call writes it again.

    The batches are kept until the next table is there, for readers that have begun; the one before last and its batches go.
    """
    read_latest(spark, root, upto).write.mode("overwrite").parquet(f"{root}/tables/upto={upto}")
    tables = sorted(r.upto for r in spark.read.parquet(f"{root}/tables").select("upto").distinct().collect())  # two or three
    for old in tables[:-2]:
        _remove(spark, f"{root}/tables/upto={old}")
    if len(tables) > 1:
        numbers = spark.read.parquet(f"{root}/batches").where(F.col("batch") <= tables[-2]).select("batch").distinct()
        for r in numbers.collect():  # as many as lie between two tables
            _remove(spark, f"{root}/batches/batch={r.batch}")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_latest(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Final responses so far.  Attempts may have come late and in any order: the highest wins, not the last.

    The newest finished table holds all batches up to its number, so reading costs the requests and the batches behind it.
    """
    batches = spark.read.parquet(f"{root}/batches")
    if upto is not None:
        batches = batches.where(F.col("batch") <= upto)
    done = []
    if _exists(spark, f"{root}/tables"):
        done = [r.upto for r in spark.read.parquet(f"{root}/tables").select("upto").distinct().collect()]
        done = [n for n in done if (upto is None or n < upto) and _exists(spark, f"{root}/tables/upto={n}/_SUCCESS")]
    if not done:
        return highest_attempts(batches.drop("batch"))
    table = spark.read.parquet(f"{root}/tables").where(F.col("upto") == max(done)).drop("upto")
    return highest_attempts(table.unionByName(batches.where(F.col("batch") > max(done)).drop("batch")))


def start_append(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", **trigger):
    return (df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())
