"""Structured Streaming forms: the same Column builders in micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert


def counts(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Windowed counts and sums with a watermark."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.window("_t", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), by, "n", "value")


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key])


def _state(spark, table: str, epoch: int) -> dict[str, int]:
    """bucket -> the epoch that last wrote it, after an epoch; one line of JSON an epoch."""
    return json.loads(spark.read.text(f"{table}/state/{epoch}").first()[0]) if epoch >= 0 else {}


def read_merged(spark, table: str, schema, epoch: int) -> DataFrame:
    """The table of merge_into after an epoch."""
    paths = [f"{table}/v{e}/bucket={b}" for b, e in _state(spark, table, epoch).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_into(table: str, key: str, now: Callable[[], str] | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: upsert into a Parquet table in buckets of the key's hash.

    A batch reads and writes only the buckets it touches; the state of an epoch says which epoch wrote each bucket last. Files are never
    changed, and a batch that is repeated starts from the state before it, so it gives the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stamp = F.to_timestamp(F.lit(now())) if now else F.current_timestamp()
        patch = batch.withColumn("last_seen", stamp).withColumn("present", F.array(*(F.lit(c) for c in [*batch.columns, "last_seen"])))
        fields, bucket = patch.drop("present"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [str(r[0]) for r in patch.select(bucket).distinct().collect()]  # at most buckets numbers
        state = _state(spark, table, epoch - 1)
        paths = [f"{table}/v{state[b]}/bucket={b}" for b in touched if b in state]
        stored = spark.read.schema(fields.schema).parquet(*paths) if paths else fields.limit(0)
        upsert(stored, patch, key).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{epoch}")
        line = json.dumps(state | dict.fromkeys(touched, epoch))
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{table}/state/{epoch}")

    return write


def observed(write: Callable[[DataFrame, int], None], quality: str, checks: dict, by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes a batch's rows by `write` and beside them, for each check, how many rows fail it.

    checks: name -> Column that is true where a row fails. Counts of an epoch are one folder that is overwritten, as `write` does with its own, so an epoch
    that is repeated changes neither; checks observe and never stop a row.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()  # both sinks see the same rows
        try:
            counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
            one = (rows.groupBy(by) if by else rows.groupBy()).agg(F.count("*").alias("rows"), *counts)
            one.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{quality}/epoch-{epoch}")
            write(rows, epoch)
        finally:
            rows.unpersist()

    return sink


def observations(spark, quality: str, by: str | None = None) -> DataFrame:
    """Counts of all epochs together."""
    seen = spark.read.parquet(f"{quality}/epoch-*").drop("epoch")
    names = [c for c in seen.columns if c != by]
    return (seen.groupBy(by) if by else seen.groupBy()).agg(*(F.sum(n).alias(n) for n in names))


def touched(df: DataFrame, before: DataFrame, key: str, columns: list[str], now) -> DataFrame:
    """df with updated_at: now where a row is new or one of the columns differs from before, else what it was."""
    old = before.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"), F.col("updated_at").alias("_was"))
    j = df.drop("updated_at").join(old, F.col(key) == F.col("_k"), "left")
    same = F.col("_k").isNotNull() & F.col("_old").eqNullSafe(F.struct(*columns))
    return j.withColumn("updated_at", F.when(same, F.col("_was")).otherwise(F.lit(now).cast("timestamp"))).drop("_k", "_old", "_was")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there and stop."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def close_stalled(runs: DataFrame, now, minutes: int = 10, slug: str | None = None) -> DataFrame:
    """Runs (of one source) still open after `minutes` have failed now, and say since when they were open."""
    at = F.lit(now).cast("timestamp")
    stale = (F.col("outcome") == "started") & F.col("finished_at").isNull() & (F.col("started_at") < at - F.make_dt_interval(mins=F.lit(minutes)))
    stale = F.coalesce(stale & (F.col("source_slug") == slug), F.lit(False)) if slug else F.coalesce(stale, F.lit(False))
    said = F.concat(F.lit("Abandoned: started "), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(", never finished (probable function time limit). Closed by a later run."))
    sample = F.col("error_sample") if "error_sample" in runs.columns else F.lit(None).cast("string")
    changed = {"outcome": F.when(stale, "failed").otherwise(F.col("outcome")), "finished_at": F.when(stale, at).otherwise(F.col("finished_at")), "error_sample": F.when(stale, said).otherwise(sample)}
    return runs.withColumns(changed)


def retain(df: DataFrame, ts: str, cutoff) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(cutoff))
