"""Workload decisions as streams.

Features are aggregated in event-time windows with a watermark; the stability rule
keeps one small state for each key.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workload
from ..plans.session import scratch


def windowed_features(events: DataFrame, window: str = "6 hours", late: str = "1 hour", key: str = "key") -> DataFrame:
    """Decisions for each key and window; on a stream they appear when the watermark passes the window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    us = workload.micros(F.col("ts"))
    share = lambda o: F.avg((F.col("op") == o).cast("double"))
    rows = timed.groupBy(F.window("ts", window).alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n"),
        share("read").alias("read_ratio"),
        share("write").alias("write_ratio"),
        share("delete").alias("delete_ratio"),
        ((F.max(us) - F.min(us)) / 1e6).alias("seconds"),
        F.max_by("size", F.struct("ts", "seq")).alias("size"),
    )
    rows = rows.withColumn("burst", workload.burst(F.col("n"), F.col("seconds")))
    return workload.decide(rows.withColumn("ts", F.col("w.end")).drop("w"))


def steady_modes(decisions: DataFrame, key: str = "key", stable_s: float = workload.STABLE_S) -> DataFrame:
    """The stability rule on a stream of decisions (key, ts, safe, confidence)."""
    stable = int(stable_s * 1_000_000)
    rows = decisions.select(F.col(key).cast("string").alias("key"), workload.micros(F.col("ts")).alias("us"), "safe", (F.col("confidence") < workload.MIN_CONFIDENCE).alias("gated"))

    def fold(of, batches, state):
        last = state.getOption
        pdf = pd.concat(list(batches)).sort_values("us", kind="stable")
        kept = []
        for m, after in workload.steady(zip(pdf["us"], pdf["safe"], pdf["gated"], strict=True), tuple(last) if last else None, stable):
            kept.append(m)
            last = after
        if last:
            state.update((int(last[0]), str(last[1])))
        yield pdf[["key", "us", "safe"]].assign(kept=kept)

    return rows.groupBy("key").applyInPandasWithState(fold, "key string, us bigint, safe string, kept string", "us bigint, mode string", "append", "NoTimeout")


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the input there is, through a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    folder = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def start_loop(decisions: DataFrame, apply, checkpoint: str, every: str = "5 minutes"):
    """Evaluates a stream of decisions again and again: ``apply(batch, number)`` gets what is new each time."""
    return decisions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
