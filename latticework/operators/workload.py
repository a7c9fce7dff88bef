"""Workload features, classification, mode selection and metrics over operation events.

Events are ``(key, op, ts, size)`` with op ``read``, ``write`` or ``delete``; ``seq``
orders events of one time. Everything but the stability rule is an expression, so
that batch and streaming plans share it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1 << 20
#: Seconds of the trailing window, events kept for it, and events that a class needs.
WINDOW_S, CAPACITY, MIN_SAMPLES = 300, 10_000, 10
MIN_CONFIDENCE, STABLE_S, LARGE_FILE = 0.7, 30, 500 * MB


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ratios(n: Column, reads: Column, writes: Column, deletes: Column) -> dict[str, Column]:
    return {"read_ratio": reads / n, "write_ratio": writes / n, "delete_ratio": deletes / n}


def features(events: DataFrame, keys: Sequence[str], window_s: float = WINDOW_S, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row for each key: ratios, operations a second, last size, count, and whether they came in a burst."""
    is_op = lambda o: F.avg((F.col("op") == o).cast("double"))
    n = F.count(F.lit(1))
    seconds = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6
    out = events.groupBy(*keys).agg(
        n.alias("n"),
        is_op("read").alias("read_ratio"),
        is_op("write").alias("write_ratio"),
        is_op("delete").alias("delete_ratio"),
        seconds.alias("seconds"),
        F.max_by("size", F.struct("ts", "seq")).alias("size"),
    )
    return out.withColumns({"rate": rate(F.col("n"), F.col("seconds")), "burst": burst(F.col("n"), F.col("seconds"), window_s, min_samples)})


def rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def burst(n: Column, seconds: Column, window_s: float = WINDOW_S, min_samples: int = MIN_SAMPLES) -> Column:
    return (n >= min_samples) & (seconds < window_s / 5)


def trailing(events: DataFrame, keys: Sequence[str], window_s: float = WINDOW_S, capacity: int | None = None) -> DataFrame:
    """Each event with the features of the events of its key in the window that ends with it.

    A capacity keeps no more than the last so many of them.
    """
    by = Window.partitionBy(*keys).orderBy("_us")
    frame = by.rangeBetween(-int(window_s * 1_000_000), 0)
    timed = events.withColumn("_us", micros(F.col("ts")))
    if capacity is not None:
        # What the window has is what there was up to now without what is too old, and what the
        # capacity leaves of it is a difference of running sums: nothing is gathered for an event.
        order = Window.partitionBy(*keys).orderBy("_us", "seq")
        old = by.rangeBetween(Window.unboundedPreceding, -int(window_s * 1_000_000) - 1)
        gone = (F.col("op") == "delete").cast("int")
        rows = timed.withColumns({"_i": F.row_number().over(order), "_d": F.sum(gone).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_old": F.count(F.lit(1)).over(old), "_old_d": F.coalesce(F.sum(gone).over(old), F.lit(0))})
        rows = rows.withColumn("_past_d", F.lag("_d", capacity, 0).over(order))
        full = F.col("_i") - F.col("_old") > capacity
        n = F.when(full, capacity).otherwise(F.col("_i") - F.col("_old")).cast("int")
        n_delete = (F.col("_d") - F.when(full, F.col("_past_d")).otherwise(F.col("_old_d"))).cast("int")
        return rows.withColumn("n", n).withColumn("n_delete", n_delete).drop("_us", "_i", "_d", "_old", "_old_d", "_past_d")
    share = lambda o: F.avg((F.col("op") == o).cast("double")).over(frame)
    n, seconds = F.count(F.lit(1)).over(frame), (F.max("_us").over(frame) - F.min("_us").over(frame)) / 1e6
    out = timed.withColumns({"n": n, "seconds": seconds, "read_ratio": share("read"), "write_ratio": share("write"), "delete_ratio": share("delete")})
    return out.drop("_us").withColumn("burst", burst(F.col("n"), F.col("seconds"), window_s))


def classify(min_samples: int = MIN_SAMPLES) -> Column:
    """The class of a row of features."""
    d, w, r = F.col("delete_ratio"), F.col("write_ratio"), F.col("read_ratio")
    return (
        F.when(F.col("n") < min_samples, "Unknown")
        .when((d > 0.6) & F.col("burst"), "BatchDeletion")
        .when((w > 0.5) & (d < 0.05), "AppendOnly")
        .when((w > 0.6) & ~F.col("burst"), "FrequentWrites")
        .when(r > 0.7, "ReadHeavy")
        .when(d < 0.2, "MixedRW")
        .otherwise("Unknown")
    )


def mode(workload: Column, size: Column) -> Column:
    """The mode that suits a class and a file size."""
    by_size = F.when(size > LARGE_FILE, "incremental").otherwise("lazy")
    return F.when(workload.isin("BatchDeletion", "ReadHeavy"), "lazy").when(workload.isin("FrequentWrites", "MixedRW"), by_size).otherwise("none")


def confidence() -> Column:
    """How far a row of features can be trusted, 0 to 1."""
    n, d = F.col("n"), F.col("delete_ratio")
    base = F.when(n >= 1000, 0.9).when(n >= 100, 0.75).when(n >= 50, 0.65).when(n >= 10, 0.5).otherwise(0.3)
    clear = F.when((d > 0.6) | (d < 0.05), 0.1).otherwise(0.0) + F.when(F.col("burst"), 0.05).otherwise(0.0)
    return F.when(n > 0, F.least(F.lit(1.0), base + clear)).otherwise(0.0)


def decide(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE, allowed: Sequence[str] = ("none", "lazy", "incremental")) -> DataFrame:
    """Features with workload, confidence, the mode that fits, and the mode that is safe."""
    out = rows.withColumn("workload", classify()).withColumn("confidence", F.round(confidence(), 4))
    out = out.withColumn("fit", mode(F.col("workload"), F.col("size")))
    return out.withColumn("safe", F.when((F.col("confidence") >= min_confidence) & F.col("fit").isin(*allowed), F.col("fit")).otherwise("none"))


def steady(rows: Iterator[tuple[int, str, bool]], last: tuple[int, str] | None = None, stable_us: int = STABLE_S * 1_000_000):
    """The stability rule over (time, mode, gated) in order; yields the kept mode and what comes next.

    Gated decisions (confidence too low, or a mode that isn't allowed) are given out
    as they are and leave no trace. Others that would change the mode too soon
    after the last one keep it, and leave no trace either.
    """
    for now, want, gated in rows:
        if gated:
            yield want, last
        elif last is not None and now - last[0] < stable_us and want != last[1]:
            yield last[1], last
        else:
            last = (now, want)
            yield want, last


def hysteresis(decisions: DataFrame, key: str, stable_s: float = STABLE_S) -> DataFrame:
    """Decisions (key, ts, fit, safe, confidence) with ``kept``, the mode after the stability rule, key by key.

    A key's decisions pass in order, a batch at a time, with one remembered decision between them.
    """
    stable = int(stable_s * 1_000_000)
    kind = decisions.schema[key].dataType.simpleString()
    rows = decisions.select(key, micros(F.col("ts")).alias("us"), "safe", (F.col("confidence") < MIN_CONFIDENCE).alias("gated"))
    # The window brings a key's rows together in order, and marks where the next key begins.
    opens = F.row_number().over(Window.partitionBy(key).orderBy("us")) == 1
    ordered = rows.withColumn("opens", opens)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            us, safe, gated, opens = (batch.column(k).to_pylist() for k in range(1, 5))
            kept = []
            for row in zip(us, safe, gated, opens, strict=True):
                mode, last = next(steady([row[:3]], None if row[3] else last, stable))
                kept.append(mode)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.string())], names=[key, "us", "safe", "kept"])

    return ordered.mapInArrow(fold, f"`{key}` {kind}, us bigint, safe string, kept string")


def size_bin(size: Column) -> Column:
    return F.when(size < 100 * MB, "small").when(size <= LARGE_FILE, "medium").otherwise("large")


def metrics(decided: DataFrame) -> DataFrame:
    """One row of counts and confidences over all decisions."""
    count = lambda c: F.sum(c.cast("long"))
    modes = {f"mode_{m}": count(F.col("safe") == m) for m in ("none", "lazy", "incremental")}
    loads = {f"workload_{w}": count(F.col("workload") == w) for w in ("Unknown", "BatchDeletion", "AppendOnly", "FrequentWrites", "ReadHeavy", "MixedRW")}
    whole = {"evaluations": F.count(F.lit(1)), "operations": F.sum("n"), "avg_confidence": F.round(F.avg("confidence"), 4), "min_confidence": F.min("confidence"), "max_confidence": F.max("confidence")}
    bins = {f"size_{b}": count(size_bin(F.col("size")) == b) for b in ("small", "medium", "large")}
    return decided.agg(*[v.alias(k) for k, v in (whole | modes | loads | bins).items()])


def lazy_due(underfull: Column, nodes: Column, since_s: Column, ratio: float = 0.05, wait_s: float = WINDOW_S) -> Column:
    """Whether a batch is due: enough underfull nodes, or time."""
    return (F.when(nodes > 0, underfull / nodes).otherwise(0.0) >= ratio) | (since_s >= wait_s)


#: What a change of mode does, by the modes before and after it: fixed values.
TRANSITIONS = {
    ("none", "lazy"): "enable lazy",
    ("none", "incremental"): "enable lazy, enable incremental, start background",
    ("lazy", "incremental"): "enable incremental, start background",
    ("lazy", "none"): "disable",
    ("incremental", "lazy"): "stop background",
    ("incremental", "none"): "stop background, disable",
}


def transition(before: Column, after: Column) -> Column:
    """The steps of a change of mode; null if the mode stays."""
    pairs = [x for (a, b), steps in TRANSITIONS.items() for x in (F.lit(f"{a}>{b}"), F.lit(steps))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(">", before, after))


def transitions(kept: DataFrame, key: str) -> DataFrame:
    """The changes of mode (key, us, before, after, steps) in a history of kept modes; every key begins with none."""
    before = F.coalesce(F.lag("kept").over(Window.partitionBy(key).orderBy("us")), F.lit("none"))
    changed = kept.withColumn("before", before).where("before <> kept")
    return changed.select(key, "us", "before", F.col("kept").alias("after"), transition(F.col("before"), F.col("kept")).alias("steps"))


def drain_seconds(left: Column, drained: Column, session_s: float = 0.1, every_s: float = 5.0) -> Column:
    """Seconds until all nodes are handled, if each session handles as many as the last; null if that handled none."""
    return F.when(left <= 0, 0.0).when(drained > 0, left / drained * (session_s + every_s))
