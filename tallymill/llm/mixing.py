"""Mixing of sources to target weights by a low-discrepancy schedule.

The documents of a source, in the order of a hash, form an endless stream that
is cut into blocks of equal numbers of words. Slots are dealt to sources by the
points of the golden ratio sequence: a point's place among the cumulative shares
names the source, and the rank of the slot among those of its source names the
block. So every stretch of the mixture, short or long, holds the sources in
about their shares. Points that come after a source has reached its target are
passed over, and blocks the points did not reach are added at the end, so each
source gives exactly its target, rounded to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.ordering import hash_salt, running_total, salts_for
from tallymill.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Size of the mixture as a share of all words, and the most copies of a source.
SHARE = 1.5
COPIES = 2
#: Words in a block.
BLOCK = 1024
#: Cells in which points are matched with shares.
CELLS = 1024

_GOLDEN = 0.6180339887498949
_STEP = 1 << 20
# the fraction of _STEP times the golden ratio, to the last digit of a double
_GOLDEN_STEP = (_STEP * 6180339887498948482045868343656 % 10**31) / 10**31


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point(i: Column) -> Column:
    """The ``i``-th multiple of the golden ratio without its whole part."""
    x = (i % _STEP) * F.lit(_GOLDEN)
    y = F.floor(i / _STEP) * F.lit(_GOLDEN_STEP)
    z = (x - F.floor(x)) + (y - F.floor(y))
    return z - F.floor(z)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """One row per source: its number in code point order, size and target.

    Targets follow the weights, stop at ``copies`` times the source's size, and
    the excess goes to the others by weight until none is above: the level at
    which sources are cut off is found among the sources sorted by capacity per
    weight. The table has a row per source; it alone goes through one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sums.withColumn("source_no", number).withColumn(
        "weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))
    )
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(copies)))
    total = F.sum("source_size").over(everything) * F.lit(share)
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio, "source_no")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - capped) / left)
    rows = rows.withColumn("ratio", ratio)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)
    target = F.least("cap", F.coalesce(level["level"], F.lit(0.0)) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_no", "source_size", "target")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots ``(slot, source_no, block)``: every block up to each target, once."""
    spark = sources.sparkSession
    needs = sources.select("source_no", F.ceil(F.round("target") / block).cast("long").alias("need")).where("need > 0")
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    shares = needs.withColumn("from", F.coalesce(F.sum("need").over(before), F.lit(0)))
    slots = needs.agg(F.sum("need")).first()[0] or 0
    shares = shares.select(
        "source_no", "need", (F.col("from") / max(slots, 1)).alias("lo"), ((F.col("from") + F.col("need")) / max(slots, 1)).alias("hi")
    )
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "source_no", "need")
    dealt = dealt.withColumn("salt", F.floor(F.col("slot") / 20_000))
    ranked = checkpoint(running_total(dealt, ["source_no"], "salt", [F.col("slot")], F.lit(1), "block"))
    reached = ranked.groupBy("source_no").agg(F.count("*").alias("reached"))
    missing = needs.join(reached, "source_no", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    added = missing.where("reached < need").select(
        "source_no", F.explode(F.sequence(F.col("reached"), F.col("need") - 1)).alias("block")
    )
    # added slots come after all others, source after source
    added = added.select(F.lit(slots) + F.xxhash64("source_no", "block") % F.lit(1 << 20) + (1 << 20), "source_no", "block")
    return ranked.where("block < need").select("slot", "source_no", "block").union(added.toDF("slot", "source_no", "block"))


def streams(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Place each document in the stream of its source: the words before it."""
    by_source = sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target")
    placed = sized.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("salt", hash_salt(F.col("h"), salts_for(rows)))
    order = [F.shiftrightunsigned("h", 33), F.col("h"), F.col("g"), F.col("doc_id"), F.col("size")]
    return running_total(placed, ["source_no"], "salt", order, F.col("size"), "place").drop("salt")


def segments(placed: DataFrame, slots: DataFrame, block: int = BLOCK, copies: int = COPIES) -> DataFrame:
    """What each slot holds: ``slot, source_no, place, pass, from_word, words``."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = placed.where("size > 0").select("source_no", "place", "size", "source_size", F.round("target").cast("long").alias("goal"), passes.alias("pass"))
    rows = rows.withColumn("lo", F.col("place") + F.col("pass") * F.col("source_size"))
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal"))).where("lo < hi")
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("lo", F.col("block") * block)
    end = F.least("hi", (F.col("block") + 1) * block)
    return rows.join(slots, ["source_no", "block"]).select(
        "slot", "source_no", "place", "pass", (begin - F.col("lo")).alias("from_word"), (end - begin).alias("words")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct each, with 128 bits that name their content."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row).select(
        "row", F.xxhash64("row").alias("h"), F.xxhash64(F.lit(1), "row").alias("g")
    )


def _sized(docs: DataFrame) -> DataFrame:
    return _keyed(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("row.source").cast("string").alias("source"),
        size_of(F.col("row.text").cast("string")).alias("size"),
        "h", "g",
    )


def takes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """How many words the mixture takes of every row of ``docs (doc_id, text, source, ...)``.

    Returns ``doc_id, h, g, source, size, source_size, target, taken``, where
    ``h`` and ``g`` are hashes of the whole row. A null source is a source of
    its own, the last. Texts without words, null ones included, are never taken.
    Of equal rows it is open which comes first; all numbers are the same in
    every run. An empty table gives no rows.
    """
    sized = checkpoint(_sized(docs))
    rows = sized.count()
    sources = checkpoint(targets(sized))
    placed = checkpoint(streams(sized, sources, rows))
    held = segments(placed, schedule(sources, block), block)
    taken = held.groupBy("source_no", "place").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, ["source_no", "place"], "left")
    return out.select(
        "doc_id", "h", "g", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mixture, with the columns of ``docs``.

    A document the mixture takes twice comes twice, one it does not take is
    gone, and the one at which a source's target ends keeps only its first
    words, joined by single spaces. Documents without words are gone.
    """
    counts = takes(docs, block).where("taken > 0").groupBy("h", "g").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size")
    )
    rows = _keyed(docs).dropDuplicates(["h", "g"]).join(counts, ["h", "g"])
    nth = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("long")))
    rows = rows.withColumn("nth", nth).withColumn("left", F.col("taken") - (F.col("nth") - 1) * F.col("size"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), " ")
    text = F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
