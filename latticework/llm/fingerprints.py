"""Document fingerprints by one-permutation MinHash.

Each shingle of a text is hashed once. The high bits of the hash name a bin, the
rest is the value that competes for the bin's minimum. Empty bins are filled by
optimal densification: every empty bin follows a probe sequence of its own,
which is the same for all texts, to the first bin that isn't empty. Of each
bin only the low bits are stored, and the likeness of two fingerprints is
corrected for the matches that few bits make by chance.

Everything is a DataFrame expression; a text is fingerprinted within its row.

Defined results:

* null text counts as empty; a text without words has the fingerprint of only
  zero digits, which is like itself (1.0) and like others by chance only;
* a text of fewer words than a shingle has one shingle, the whole sequence;
* equal texts have equal fingerprints; repeated shingles count once;
* repeated rows give repeated results; of equal ids the order is that of a hash
  of the text, and rows equal in both are interchangeable;
* ids may be any 64-bit numbers, in clusters, far apart or null; an empty table
  gives no rows;
* a very long text is hashed within its row: memory is eight bytes a word and
  shingle, time that of sorting them; other columns are kept by the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import key_ranges
from .common import cut, let, table, text_words

BINS, BITS, SHINGLE = 256, 8, 5
#: Probes tried one after the other before all bins that have values are ranked.
PROBES = 24
#: Bands of bins for near-duplicates, and the likeness that counts as one: two standard errors of 256 bins below 0.8.
BANDS, NEAR = 32, 0.75
#: Documents that cyclic_next() sorts together, on average.
ROWS_TOGETHER = 256


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> Column:
    """``bins * bits / 4`` hexadecimal digits, ``bits / 4`` for each bin.

    ``bins`` is a power of two and ``bits`` a multiple of 4, at most 12.
    """
    if bins & (bins - 1) or not 2 <= bins <= 4096 or bits not in (4, 8, 12):
        raise ValueError("bins must be a power of two up to 4096, bits 4, 8 or 12")
    shift = 64 - (bins.bit_length() - 1)
    low = (1 << shift) - 1
    digits = bits // 4
    table_ = F.array(*[F.lit(f"{v:0{digits}x}") for v in range(1 << bits)])
    #: One value that no minimum exceeds for each bin, so that every bin has a first value after sorting.
    ends = F.array(*[F.lit(((b - bins // 2) << shift) | low).cast("long") for b in range(bins)])

    def hashes(words: Column) -> Column:
        # get() is null beyond the last word, and a null leaves a hash as it is.
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])))

    def first_of_bins(ordered: Column) -> Column:
        def opens(x, i):
            return (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(ordered, i - 1), shift))

        return F.filter(ordered, opens)

    def stored(minima: Column) -> Column:
        return F.transform(minima, lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))

    def dense(values: Column) -> Column:
        def filled(full: Column) -> Column:
            def ranked(i):
                rank = F.transform(full, lambda j: F.struct(F.hash(i, j, F.lit(PROBES)).alias("p"), F.get(values, j).alias("v")))
                return F.array_min(rank)["v"]

            def fill(x, i):
                probes = [F.get(values, F.hash(i, F.lit(a)).bitwiseAND(F.lit(bins - 1))) for a in range(PROBES)]
                return F.coalesce(x, *probes, ranked(i), F.lit(0))

            return F.transform(values, fill)

        return let(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.get(values, j).isNotNull()), filled)

    def packed(words: Column) -> Column:
        ordered = F.sort_array(F.concat(hashes(words), ends))
        values = let(let(ordered, first_of_bins), stored)
        return F.when(F.size(words) > 0, F.array_join(F.transform(let(values, dense), lambda v: F.get(table_, v)), "")).otherwise(F.lit("0" * (bins * digits)))

    return let(text_words(text), packed)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS, packed: bool = False) -> Column:
    """The estimated resemblance of two fingerprints' shingle sets, 0 to 1.

    Bins that agree by chance, one in ``2 ** bits``, are taken out. ``packed``
    fingerprints are binary, a byte for each bin of 8 bits.
    """
    if packed and bits != 8:
        raise ValueError("packed fingerprints have 8 bits a bin")
    digits, chance = 1 if packed else bits // 4, 2.0**-bits

    def agree(pair: Column) -> Column:
        def one(n, i):
            same = F.substring(pair["a"], i * digits + 1, F.lit(digits)) == F.substring(pair["b"], i * digits + 1, F.lit(digits))
            return n + F.when(same, 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), one)

    share = let(F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b")), agree) / F.lit(float(bins))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def band_links(prints: DataFrame, least: float = NEAR) -> DataFrame:
    """Links (node, first) between rows whose packed fingerprints have a likeness of ``least`` or more.

    ``prints`` has distinct nodes, ``print`` and ``bands``, a key for each band of
    bins, and is kept as a table. Rows that agree in a band meet, each is paired
    with the smallest node there, and the pairs are verified once. Two texts of
    resemblance 0.8 agree in one of 32 bands of 8 bins in 997 of 1000 cases. A band that any
    share of the rows agrees in costs one row a task and an equi-join that adaptive
    execution can split; rows that are alike, but neither of which is like the
    smallest of a band, meet in another band or through a third.
    """
    banded = prints.select("node", F.explode("bands").alias("band"))
    firsts = banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = cut(firsts.select(F.col("band").alias("of"), "first"))
    pairs = cut(banded.join(firsts, F.col("band") == F.col("of")).where("node != first").select("node", "first").distinct())
    left = prints.select(F.col("node").alias("a"), F.col("print").alias("a_print"))
    right = prints.select(F.col("node").alias("b"), F.col("print").alias("b_print"))
    met = cut(pairs.join(left, F.col("node") == F.col("a")).select("node", "first", "a_print")).join(right, F.col("first") == F.col("b"))
    return met.where(likeness(F.col("a_print"), F.col("b_print"), packed=True) >= least).select("node", "first")


def cyclic_next(df: DataFrame, key: str, columns: list[str], tie: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``derived`` columns, and ``next``, a struct of ``columns`` and these of the row after it in descending ``key``.

    Null keys come last, in the order of a hash of ``tie``; ties go by that hash
    and then ``tie`` itself. After the last row comes the first. The rows are
    dealt by ranges between the key's quantiles, whatever 64-bit numbers the keys
    are, so that no task sees more than a few ranges; only each range's first row
    travels to the range above.
    """
    ranges = key_ranges(df, key)
    parts = max(1, ranges.rows // ROWS_TOGETHER)
    spot = F.shiftrightunsigned(F.xxhash64(F.col(tie)), 32)
    share = spot / float(1 << 32)
    near = F.coalesce(ranges.range_of(F.col(key), ROWS_TOGETHER, share), -1 - F.floor(share * parts)).cast("long")
    rows = df.withColumn("_range", near)
    order = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), spot, F.col(tie))
    derived = derived or {}
    names = [*columns, *derived]
    # Single columns, as a struct of them would go through the shuffle beside them.
    ahead = {f"_next_{c}": F.lead(c).over(order) for c in names} | {"_more": F.lead(F.lit(True)).over(order)}
    # What is derived comes after the shuffle, in as many tasks as that has.
    seen = rows.repartition("_range").withColumns(derived).withColumns(ahead)
    # Few rows are first in their range: they are found before anything is derived from them.
    heads = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").withColumns(derived).select(F.col("_range").alias("_of"), F.struct(*names).alias("_head"))

    # The next lower range that has rows: within groups of 512 ranges, then over the groups.
    ranges = rows.select("_range").distinct().withColumn("_group", F.floor(F.col("_range") / 512))
    inside = ranges.withColumn("_below", F.lead("_range").over(Window.partitionBy("_group").orderBy(F.desc("_range"))))
    tops = ranges.groupBy("_group").agg(F.max("_range").alias("_top"))
    whole = Window.orderBy(F.desc("_group"))
    tops = tops.withColumn("_then", F.coalesce(F.lead("_top").over(whole), F.first("_top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    links = inside.join(tops, "_group").select(F.col("_range"), F.coalesce("_below", "_then").alias("_of"))

    follow = links.join(heads, "_of").select("_range", "_head")
    found = F.when(F.col("_more"), F.struct(*[F.col(f"_next_{c}").alias(c) for c in names])).otherwise(F.col("_head"))
    return seen.join(follow, "_range", "left").withColumn("next", found).drop("_range", "_head", *ahead)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness to it and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = cyclic_next(docs, "doc_id", ["text"], "text", {"fingerprint": fingerprint(F.col("text"))})
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - half), F.substring(F.col("next")["text"], F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next")["fingerprint"].alias("next_fingerprint"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
