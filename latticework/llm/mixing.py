"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target of words. The mix is a sequence of slots, each of
``BLOCK`` words. The van der Corput point of a slot's number is mapped through
the sources' cumulative slot counts and so names its source; as the points are
evenly spread over every prefix, each source keeps its share at every point of
the mix, and gets exactly its count of slots at the end. A slot's rank among its
source's slots names the block that it takes: the source's documents, shuffled by
a keyed hash, form one stream of words that is cut into blocks of equal size, and
that starts over where the target is more than the source has.

Ranks have a closed form, so no window runs over a source's slots. Offsets in a
source's stream are summed in pieces of its hash order, so a hot source is dealt
over as many tasks as it has pieces. Slots and blocks meet in an equi-join on
(source, block), whose keys hold about a block's worth of documents each.

The driver sees one row for each source, of which there may be ``MAX_SOURCES``.

Defined results:

* null text counts no words; documents without words are never taken;
* a null source is a source of its own, after all others; sources without words
  have the target 0; an empty table gives no rows;
* rows with equal ids and texts are taken each for itself; ties are broken by
  id, size and text hash, so reruns agree;
* other columns are kept whatever their names; those named like the columns that
  mix() adds are replaced;
* a very long text is only measured and hashed where it lies; a document of many
  words spans as many blocks, and has a row for each.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import LocalDataToArrowConversion

from .common import cut, power_of_two, table, unwrapped, word_count, wrapped

#: Weights by the sources' order, repeating; the mix's words by those there are; the most times that a source is read.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), Fraction(3, 2), 2
#: Words in a slot and in a block.
BLOCK = 256
SEED = 2
#: Documents in a piece of a source's order, on average over all sources, and the most pieces.
PIECE_ROWS, MAX_PIECES = 256, 1 << 16
MAX_SOURCES = 2_000
#: Slots in one task, and the most sources that are told apart by compiled comparisons.
SLOTS_TOGETHER, TREE = 1 << 16, 200


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, epochs: int = EPOCHS) -> list[Fraction]:
    """Words of each source, by weight, none above ``epochs`` times its size; the excess is shared anew."""
    out, free, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), Fraction(share) * sum(sizes)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > epochs * sizes[i] * whole]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(epochs * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def plan(df: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> list[tuple]:
    """(source, size, target, words taken) of each source in the order of code points, null last."""
    rows = df.groupBy(source).agg(F.sum(size)).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, epochs)
    return [(r[0], s, float(t), min(epochs * s, round(t))) for r, s, t in zip(rows, sizes, wanted, strict=True)]


def reversed_bits(n: Column, bits: int) -> Column:
    """The van der Corput point of ``n``, times ``2 ** bits``."""
    out = F.lit(0).cast("long")
    for j in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(n, j).bitwiseAND(F.lit(1)), bits - 1 - j))
    return out


def rank_below(n: Column, point: Column, a: Column, bits: int) -> Column:
    """How many of the numbers below ``n`` have points below ``a``; ``point`` is that of ``n``.

    The numbers below ``n`` fall into one aligned run for each set bit j. The
    points of a run are ``2 ** (bits - j)`` apart, and its first one is that of
    ``n`` without the bits that j and those below it are mapped to.
    """
    out = F.lit(0).cast("long")
    for j in range(bits):
        first, step = point.bitwiseAND(F.lit((1 << (bits - 1 - j)) - 1)), bits - j
        inside = F.shiftright(F.greatest(a - first, F.lit(0)) + ((1 << step) - 1), step)
        out = out + F.when(F.shiftright(n, j).bitwiseAND(F.lit(1)) == 1, F.least(inside, F.lit(1 << j))).otherwise(0)
    return out


def _search(point: Column, ends: list[int], first: int) -> Column:
    """``first`` plus how many of the sorted ``ends`` aren't above ``point``, by halving; compiled, unlike a lambda."""
    if len(ends) <= 1:
        return F.lit(first)
    half = len(ends) // 2
    return F.when(point < ends[half - 1], _search(point, ends[:half], first)).otherwise(_search(point, ends[half:], first + half))


def schedule(spark, taken: list[int], block: int = BLOCK) -> DataFrame:
    """(slot, place, block, words): the order in which sources, by place in ``taken``, give their blocks.

    ``block`` counts on through the repeats of a source; the last one of a source may have fewer words.
    """
    counts = [-(-t // block) for t in taken]
    total = sum(counts)
    bits = max(1, (max(total, 1) - 1).bit_length())
    edges, at = [], 0
    for i, (n, t) in enumerate(zip(counts, taken, strict=True)):
        if n:
            edges.append((i, at, at + n, t))
        at += n
    slots = spark.range(0, 1 << bits, 1, max(1, (1 << bits) // SLOTS_TOGETHER)).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point")).where(F.col("point") < total)
    if not edges:
        return slots.select("slot", F.lit(0).alias("place"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("words")).limit(0)
    if len(edges) <= TREE:
        which = _search(F.col("point"), [e[2] for e in edges], 0)
    else:
        which = F.size(F.filter(F.array(*[F.lit(e[2]).cast("long") for e in edges]), lambda e: e <= F.col("point")))
    found = slots.withColumn("which", which)
    pick = {k: F.get(F.array(*[F.lit(e[j]).cast("long") for e in edges]), F.col("which")) for j, k in enumerate(("place", "lo", "hi", "all"))}
    found = found.select("slot", "point", *[c.alias(k) for k, c in pick.items()])
    rank = rank_below(F.col("slot"), F.col("point"), F.col("hi"), bits) - rank_below(F.col("slot"), F.col("point"), F.col("lo"), bits)
    found = found.select("slot", F.col("place").cast("int").alias("place"), rank.alias("block"), "all")
    return found.select("slot", "place", "block", F.least(F.lit(block).cast("long"), F.col("all") - F.col("block") * block).alias("words"))


def streams(df: DataFrame, place: str, size: str, keys: list[str], count: int, seed: int = SEED) -> DataFrame:
    """``df`` with ``_offset``, where each document begins in its source's shuffled stream of words, and ``_row``, its number in ``place``."""
    pieces = power_of_two(count / PIECE_ROWS, MAX_PIECES)
    code = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    piece = F.shiftrightunsigned("_code", 64 - (pieces.bit_length() - 1)) if pieces > 1 else F.lit(0)
    rows = df.withColumn("_code", code).withColumn("_piece", piece.cast("long"))
    sums = rows.groupBy(place, "_piece").agg(F.sum(size).alias("_words"))
    before = Window.partitionBy(place).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(place, "_piece", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(place, "_piece").orderBy("_code", *keys)
    within = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_within", within).withColumn("_row", F.shiftleft("_piece", 40) + F.row_number().over(inside))
    return rows.join(starts, [place, "_piece"]).withColumn("_offset", F.col("_start") + F.col("_within")).drop("_code", "_piece", "_start", "_within")


def mix(df: DataFrame, source: str, size: str, keys: list[str], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """What each slot of the mix takes from each document.

    The columns of ``df`` with ``place``, ``row`` (these two tell its rows from
    each other), ``source_size`` and ``target``, and for each slot that takes words
    of it ``slot``, ``epoch``, ``first`` (the word of the document it begins with)
    and ``words``. A document that isn't taken has one row, with 0 words. ``keys``
    are the columns that the shuffle is keyed by; ``block`` is a power of two.
    """
    spark = df.sparkSession
    shift = block.bit_length() - 1
    if block != 1 << shift:
        raise ValueError("block must be a power of two")
    rows = plan(df, source, size, weights, share, epochs)
    kinds = [("_source", df.schema[source].dataType), ("_place", T.IntegerType()), ("_of", T.LongType()), ("_target", T.DoubleType()), ("_all", T.LongType())]
    # Handed over as an Arrow table: plain rows would pass through Python workers, which stay in the executors' memory.
    fields = T.StructType([T.StructField(*k) for k in kinds])
    given = [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
    listed = spark.createDataFrame(given and LocalDataToArrowConversion.convert(given, fields, False), fields)
    doc, names = F.col("_doc"), [f"_key_{k}" for k in range(len(keys))]
    own = wrapped(df).select("_doc", doc[size].cast("long").alias("_size"), *[doc[k].alias(n) for k, n in zip(keys, names, strict=True)])
    # At most MAX_SOURCES rows.
    placed = own.join(F.broadcast(listed), doc[source].eqNullSafe(F.col("_source"))).drop("_source")
    laid = streams(placed, "_place", "_size", names, df.count())
    slots = schedule(spark, [r[3] for r in rows], block).select(F.col("place").alias("_slot_place"), F.col("block").alias("_slot_block"), F.col("slot").alias("_slot"), F.col("words").alias("_slot_words"))

    # The blocks that a document has words in, in every pass through its source that the slots come to.
    def blocks(e: int) -> Column:
        begin = F.col("_offset") + e * F.col("_of")
        end = F.least(begin + F.col("_size"), F.col("_all")) - 1
        each = F.transform(F.sequence(F.shiftright(begin, shift), F.shiftright(end, shift)), lambda b: F.struct(F.lit(e).alias("epoch"), b.alias("block")))
        return F.when(begin <= end, each).otherwise(F.array().cast("array<struct<epoch:int,block:bigint>>"))

    parts = laid.withColumn("_part", F.explode_outer(F.concat(*[blocks(e) for e in range(epochs)])))
    # Documents that aren't taken meet no slot; they are spread over keys that no block has.
    spread = -1 - F.pmod(F.hash("_row"), F.lit(1 << 20))
    parts = parts.withColumn("_block", F.coalesce("_part.block", spread.cast("long"))).withColumn("_begin", F.col("_offset") + F.col("_part.epoch") * F.col("_of"))
    meet = parts.join(slots, (F.col("_place") == F.col("_slot_place")) & (F.col("_block") == F.col("_slot_block")), "left")
    lo = F.greatest(F.col("_begin"), F.shiftleft("_block", shift))
    hi = F.least(F.col("_begin") + F.col("_size"), F.shiftleft("_block", shift) + F.col("_slot_words"))
    words = F.when(F.col("_slot").isNull(), 0).otherwise(hi - lo).cast("long")
    added = {"place": F.col("_place"), "row": F.col("_row"), "source_size": F.col("_of"), "target": F.col("_target"), "slot": F.col("_slot"), "epoch": F.col("_part.epoch"), "first": lo - F.col("_begin"), "words": words}
    return unwrapped(meet, df.columns, **added)


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` as often as the mix takes them.

    A pass through a source gives a document if it takes at least half of its
    words, and some; so texts stay whole. Rows that are equal in id, source and
    text share what the mix takes of them as evenly as whole rows allow.
    """
    code = F.xxhash64(F.col(text))
    light = cut(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), code.alias("code")))
    taken = mix(light, "source", "size", ["id", "size", "code"]).groupBy("place", "row", "id", "source", "size", "code", "epoch").agg(F.sum("words").alias("words"))
    whole = (F.col("words") > 0) & (2 * F.col("words") >= F.col("size"))
    copies = taken.groupBy("id", "source", "code").agg(F.sum(whole.cast("int")).alias("copies"), F.count_distinct("row").alias("rows")).where("copies > 0")
    copies = cut(copies)
    doc = F.col("_doc")
    met = wrapped(docs).join(copies, doc[doc_id].eqNullSafe(F.col("id")) & doc[source].eqNullSafe(F.col("source")) & (F.xxhash64(doc[text]) == F.col("code")))
    out = met.where("rows = 1").select("_doc", F.col("copies").alias("times"))
    if not copies.where("rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("id", "source", "code").orderBy(F.lit(0)))
        share = F.expr("copies div rows") + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("int")
        shared = met.where("rows > 1").withColumn("nth", nth).select("_doc", share.alias("times"))
        out = out.unionByName(shared).where("times > 0")
    return unwrapped(out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats counted."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("code"))
    # Only these columns are read again, for the sources' sizes and the shuffle.
    mixed = mix(cut(sized), "source", "size", ["doc_id", "size", "code"])
    out = mixed.groupBy("place", "row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
