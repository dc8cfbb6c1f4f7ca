"""Line dedup by a template tree of fixed depth, in DataFrame functions only.

A line goes down the tree by its number of words and its first ``DEPTH`` words,
a word with a digit being any word. In a leaf, a word that recurs at its place
in lines of at least ``MIN_DOCS`` documents is constant and every other word is
a variable field. The constants and their places are the line's template, if
they are most of the words without a digit; the template of any other line is
the line itself, word for word. A template that occurs in at least ``MIN_DOCS`` different
texts is dropped from all of them but its first place, so that what copies of a
document share is not lost with all of them.

Texts stay where they are until the last step. Only hashes of lines are counted,
and only words of lines in leaves that can recur are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import checkpoint

DEPTH = 3
MIN_DOCS = 5
#: Least constants of a template, and their least share of the words without a digit.
MIN_WORDS = 3
CONSTANT = 0.7
#: Bits of the filter for leaves that can recur; its size is fixed.
FILTER_BITS = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
BREAKS = r"[\x20\x09-\x0D]+"
ANY = "<*>"


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit(ANY)).otherwise(word)


def _leaf(line: Column) -> Column:
    """Number of words and masked first words, as a hash."""
    # the first words are cut off before they are split, so long lines cost no more
    first = F.regexp_extract(line, rf"[\x20\x09-\x0D]*((?:{WORD}{BREAKS}){{0,{DEPTH - 1}}}(?:{WORD})?)", 1)
    return F.xxhash64(F.regexp_count(line, F.lit(WORD)), F.transform(F.split(first, BREAKS), _masked))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    # hashed and split before the lines part, so that no line carries its text along
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("lines"))
    lines = whole.select("doc_id", "h", F.posexplode("lines").alias("pos", "line"))
    return lines.where(F.regexp_count("line", F.lit(WORD)) > 0).withColumn("leaf", _leaf(F.col("line")))


def _in_filter(leaves: DataFrame) -> Column:
    """Whether a leaf may be among ``leaves``, by a bitmap of fixed size."""
    place = F.pmod(F.col("leaf"), F.lit(FILTER_BITS))
    words = leaves.select(F.floor(place / 64).alias("at"), F.expr("shiftleft(1L, cast(pmod(leaf, 64) as int))").alias("bit"))
    found = {r["at"]: r.bits for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}
    bitmap = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(FILTER_BITS // 64))), ",").cast("array<bigint>")
    return F.getbit(F.element_at(bitmap, (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int")) == 1


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur in at least MIN_DOCS different texts."""
    return rows.select(key, "h").distinct().groupBy(key).agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_DOCS)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """Lines to drop: ``doc_id, h, pos``, with ``h`` the hash of the text."""
    leaves = checkpoint(_recurring(_lines(docs), "leaf").select("leaf"))
    held = _lines(docs).where(_in_filter(leaves)).join(leaves, "leaf", "left_semi")
    words = F.filter(F.split("line", BREAKS), lambda w: w != "")
    held = held.select("doc_id", "h", "pos", "leaf", F.transform(words, _masked).alias("words"), F.xxhash64(words).alias("same"))
    held = checkpoint(held.withColumn("line", F.xxhash64("leaf", "words")))

    # a line that comes again and again is looked at once, with its number of texts
    texts = held.select("line", "h").distinct().groupBy("line").agg(F.count("*").alias("texts"))
    kinds = held.groupBy("line").agg(F.min(F.struct("leaf", "words")).alias("kind")).join(texts, "line")
    kinds = checkpoint(kinds.select("line", "texts", "kind.leaf", F.posexplode("kind.words").alias("at", "word")))
    constant = kinds.groupBy("leaf", "at", "word").agg(F.sum("texts").alias("n")).where((F.col("n") >= MIN_DOCS) & (F.col("word") != ANY))
    fields = kinds.join(constant.select("leaf", "at", "word", F.lit(1).alias("fixed")), ["leaf", "at", "word"], "left")
    templates = fields.groupBy("line", "leaf").agg(
        F.count(F.when(F.col("word") != ANY, 1)).alias("plain"),
        F.count("fixed").alias("constants"),
        F.bit_xor(F.when(F.col("fixed") == 1, F.xxhash64("at", "word"))).alias("code"),
    )
    enough = (F.col("constants") >= MIN_WORDS) & (F.col("constants") >= CONSTANT * F.col("plain"))
    templates = templates.where(enough).select(
        "line", F.xxhash64("leaf", "code", "constants").alias("template")
    )
    itself = F.xxhash64(F.lit("same"), "same")
    placed = held.select("doc_id", "h", "pos", "line", "same").join(templates, "line", "left")
    placed = checkpoint(placed.select("doc_id", "h", "pos", F.coalesce("template", itself).alias("template")))
    first = placed.groupBy("template").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"))
    out = placed.join(_recurring(placed, "template").join(first, "template"), "template")
    return out.where((F.col("h") != F.col("first.h")) | (F.col("pos") != F.col("first.pos"))).select("doc_id", "h", "pos")


def _bitmaps(drops: DataFrame) -> DataFrame:
    """``doc_id, h, positions, bits``: the lines to drop of each text, as numbers and as bits of 64 lines each."""
    words = drops.groupBy("doc_id", "h", F.floor(F.col("pos") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.collect_set("pos").alias("part")
    )
    texts = words.groupBy("doc_id", "h").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("by_word"),
        F.max("at").alias("last"),
        F.sort_array(F.flatten(F.collect_list("part"))).alias("positions"),
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("by_word", i), F.lit(0)))
    return texts.select("doc_id", "h", "positions", dense.alias("bits"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, ...)`` without lines of recurring templates.

    All columns and rows stay; ``text`` loses lines and ``_n_lines`` and
    ``_dropped`` (an array of line numbers from 0, null if none) are added, in
    place of columns of these names. Lines end at line feeds. Lines without words
    are never dropped, those of fewer than ``MIN_WORDS`` words only if they recur
    word for word. Equal texts count as one when documents are counted, so a
    document that is copied whole keeps its lines unless others have them too. A
    null text stays null. Rows with equal ``doc_id`` and text are treated alike.
    An empty table stays empty. A line costs the same in a text of any number of
    lines.
    """
    drops = _bitmaps(recurring_lines(docs.select(F.col("doc_id"), F.col("text"))))
    drops = drops.select(F.col("doc_id").alias("drop_id"), F.col("h").alias("drop_h"), "positions", "bits")
    # a row is one column, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    keyed = rows.join(
        drops, F.col("row.doc_id").cast("long").eqNullSafe(F.col("drop_id")) & (F.xxhash64(text) == F.col("drop_h")), "left"
    )
    lines = F.split(text, "\n")

    def dropped(at: Column) -> Column:
        word = F.get("bits", F.floor(at / 64).cast("int"))
        return F.coalesce(F.getbit(word, at % 64) == 1, F.lit(False))

    left = F.filter(
        F.transform(lines, lambda line, at: F.when(~dropped(at), line)), lambda line: line.isNotNull()
    )
    kept = F.when(F.col("positions").isNull(), text).otherwise(F.array_join(left, "\n"))
    own = [c for c in docs.columns if c not in ("_n_lines", "_dropped")]
    return keyed.select(
        *[kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("_n_lines"), F.col("positions").alias("_dropped"),
    )
