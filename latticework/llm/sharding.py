"""A uniform shuffle into shards of exact sizes.

Rows are first dealt to logical partitions by a hash of their key columns. From
the partitions' row counts alone a communication matrix is drawn: how many rows
of each partition go to each shard follows the multivariate hypergeometric law
that a uniform permutation would give, at any size. Every partition orders its
rows by a keyed hash and cuts that order by its row of the matrix; every shard then
orders what it gets by a second keyed hash, in pieces whose offsets are summed first.

Only DataFrame expressions touch the rows. The driver sees one count for each
logical partition, at most ``MAX_PARTS`` of them.

Defined results:

* shard sizes differ by one row at most (the ``rows`` law), and slots count from
  0 without gaps in each shard; reruns give the same result;
* null keys and null texts are dealt like others; rows that are equal in all key
  columns are interchangeable; an empty table gives no rows;
* other columns are kept, whatever their names; columns named ``shard`` or
  ``slot`` are replaced; a very long text travels with its row and isn't looked at.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, table, unwrapped, wrapped

SHARDS, SEED = 40, 20
#: Rows that a logical partition holds on average, and the most partitions.
PART_ROWS, MAX_PARTS = 512, 4096
#: Rows in a piece of a shard on average, and the most pieces a shard.
PIECE_ROWS, MAX_PIECES = 256, 1 << 20
#: numpy draws from fewer than so many of each kind.
NUMPY_MOST = 10**9
HALF_LOG_2PI = Decimal("0.91893853320467274178032973640561763986139747363778")


def log_factorial(n: int) -> Decimal:
    """To more than 20 decimal places below 10^15, by Stirling's series."""
    with localcontext(prec=40):
        if n < 256:
            return Decimal(math.factorial(n)).ln()
        x = Decimal(n)
        return (x + Decimal("0.5")) * x.ln() - x + HALF_LOG_2PI + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among those drawn; numpy's law without its bound.

    Devroye's rejection for log-concave laws: with mode m of probability p, the
    probability of m + x is at most p min(1, e^(1 - p |x|)). Numbers are whole, and
    logarithms of factorials precise enough for differences between large ones.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = (drawn + 1) * (good + 1) // (good + bad + 2)

    def weight(k: int) -> Decimal:
        with localcontext(prec=40):
            return -sum(map(log_factorial, (k, good - k, drawn - k, bad - drawn + k)))

    top = weight(mode)
    with localcontext(prec=40):
        p = float((top + sum(map(log_factorial, (good, bad, drawn, good + bad - drawn))) - log_factorial(good + bad)).exp())
    w = 1 + p / 2
    while True:
        u, v, z = 1 - rng.random(3)
        y = v * w / p if u <= w / (1 + w) else (w - math.log(v)) / p
        k = mode + round(y) * (1 if rng.random() < 0.5 else -1)
        if low <= k <= high and math.log(z) + min(0.0, w - p * y) <= float(weight(k) - top):
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int = SEED) -> np.ndarray:
    """How many rows of each partition go to each shard; exact in both margins."""
    rng, left, drawn = np.random.default_rng(seed), np.array(sizes, dtype=np.int64), []
    for n in counts:
        row, rest, total = np.zeros(len(left), dtype=np.int64), int(n), int(left.sum())
        for s in range(len(left)):
            # One shard against those after it.
            good, bad = int(left[s]), total - int(left[s])
            if rest == 0:
                break
            if max(good, bad) < NUMPY_MOST:
                k = int(rng.hypergeometric(good, bad, rest)) if good + bad else 0
            else:
                k = hypergeometric(rng, good, bad, rest)
            row[s], rest, total = k, rest - k, bad
        left = left - row
        drawn.append(row)
    return np.array(drawn, dtype=np.int64).reshape(len(counts), len(sizes))


def uniform_shards(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform permutation cut into shards of equal size."""
    spark = df.sparkSession
    total = df.count()
    parts = power_of_two(total / PART_ROWS, MAX_PARTS)
    pieces = power_of_two(total / shards / PIECE_ROWS, MAX_PIECES)
    rows = wrapped(df).select("_doc", *[F.col("_doc")[k].alias(f"key_{i}") for i, k in enumerate(keys)])
    names = [F.col(f"key_{i}") for i in range(len(keys))]
    rows = rows.withColumn("_shard_part", F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(parts)).cast("int"))
    rows = rows.withColumn("_shard_first", F.xxhash64(F.lit(seed + 1), *names)).withColumn("_shard_last", F.xxhash64(F.lit(seed + 2), *names))

    found = {r[0]: r[1] for r in rows.groupBy("_shard_part").count().collect()}
    counts = [found.get(p, 0) for p in range(parts)]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = communication_matrix(counts, sizes, seed).cumsum(axis=1)
    listed = json.dumps([{"p": p, "ends": [int(x) for x in e]} for p, e in enumerate(ends)])
    matrix = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<p:int,ends:array<bigint>>>")).alias("m")).select(F.col("m.p").alias("_shard_p"), F.col("m.ends").alias("_shard_ends"))

    # Permute locally, and cut each partition's order by its row of the matrix.
    local = Window.partitionBy("_shard_part").orderBy("_shard_first", *names)
    dealt = rows.withColumn("_shard_n", F.row_number().over(local) - 1)
    # At most MAX_PARTS rows of one count a shard each.
    dealt = dealt.join(F.broadcast(matrix), F.col("_shard_part") == F.col("_shard_p"))
    shard = F.size(F.filter("_shard_ends", lambda e: e <= F.col("_shard_n"))).cast("int")
    piece = F.shiftrightunsigned(F.col("_shard_last"), 64 - (pieces.bit_length() - 1)) if pieces > 1 else F.lit(0)
    dealt = dealt.select("_doc", *names, shard.alias("shard"), piece.cast("int").alias("_shard_piece"), "_shard_last")

    # Permute again: pieces of a shard in the order of the second hash, after the rows of the pieces before.
    sums = dealt.groupBy("shard", "_shard_piece").agg(F.count(F.lit(1)).alias("_shard_rows"))
    before = Window.partitionBy("shard").orderBy("_shard_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "_shard_piece", F.coalesce(F.sum("_shard_rows").over(before), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard", "_shard_piece").orderBy("_shard_last", *names)
    placed = dealt.withColumn("_shard_n", F.row_number().over(inside) - 1).join(starts, ["shard", "_shard_piece"])
    return unwrapped(placed, df.columns, shard=F.col("shard"), slot=(F.col("_shard_start") + F.col("_shard_n")).cast("long"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are one apart at most."""
    # A null text has no bytes.
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
