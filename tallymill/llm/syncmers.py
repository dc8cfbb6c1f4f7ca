"""Document fingerprints from closed syncmers, in DataFrame functions only.

Tokens are words, longer ones in parts of ``TOKEN`` characters. Of all runs of
``K`` tokens those are anchors whose inner run of ``S`` tokens with the smallest
hash is the first or the last. Whether a run is an anchor depends on its own
tokens only, so two texts that share a passage share its anchors, whatever
stands around it. The ``SIZE`` smallest hashes of the anchors are the
fingerprint; the share of common ones among the smallest of both estimates how
much of two texts is alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.ordering import salts_for
from tallymill.session import checkpoint

TOKEN = 12
K = 6
S = 2
SIZE = 64

_INNER = K - S + 1


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, behind a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_inner(df: DataFrame, text: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0))
    df = _settled(df, "_words", F.transform(tokens, lambda t: F.xxhash64(t)))
    following = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0)))
    inner = F.zip_with(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), following, lambda a, b: F.xxhash64(a, b))
    return _settled(df, "_inner", inner)


def _runs() -> Column:
    """Every run of K tokens as the hashes of its inner runs."""
    n = F.size("_inner")
    shifted = [F.slice("_inner", F.lit(j + 1), F.greatest(n - (_INNER - 1), F.lit(0))).alias(f"r{j}") for j in range(_INNER)]
    return F.arrays_zip(*shifted)


def _is_anchor(run: Column) -> Column:
    return F.least(run["r0"], run[f"r{_INNER - 1}"]) <= F.least(*[run[f"r{j}"] for j in range(1, _INNER - 1)])


def _code(run: Column) -> Column:
    return F.xxhash64(*[run[f"r{j}"] for j in range(0, _INNER, S)])


def with_anchors(df: DataFrame, text: str = "text", name: str = "anchors") -> DataFrame:
    """Add the anchors in order, as structs of token position and hash."""
    df = _with_inner(df, text)
    runs = F.transform(_runs(), lambda run, at: F.struct(at.alias("position"), F.when(_is_anchor(run), _code(run)).alias("hash")))
    return df.withColumn(name, F.filter(runs, lambda r: r["hash"].isNotNull())).drop("_words", "_inner")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted smallest anchor hashes, cut to 32 bits.

    A text of fewer than K tokens has the hash of all of them, one without
    tokens none.
    """
    df = _with_inner(df, text)
    codes = F.transform(F.filter(_runs(), _is_anchor), lambda run: _code(run))
    short = F.when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>"))
    codes = F.when(F.size("_words") < K, short).otherwise(codes)
    codes = F.transform(codes, lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)))
    return _settled(df, name, F.slice(F.array_sort(F.array_distinct(codes)), 1, SIZE)).drop("_words", "_inner")


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors; 1 for two texts without tokens."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def _next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_chars`` of each different row with ``next_id, next_h``.

    Ids are dealt to ranges; the last of a range is followed by the first of the
    next range, which a table with a row per range knows.
    """
    ids = docs.select("doc_id", "h", "n_chars").distinct()
    parts = salts_for(docs.select("doc_id").count())
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ids = ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ids = checkpoint(ids)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = ids.groupBy("part").agg(F.min(key).alias("first"))
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after"))
    within = F.lead(key).over(Window.partitionBy("part").orderBy(*order))
    found = ids.withColumn("following", within).join(firsts, "part")
    found = found.withColumn("following", F.coalesce("following", "after"))
    return found.select("doc_id", "h", "n_chars", F.col("following.doc_id").alias("next_id"), F.col("following.h").alias("next_h"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts of ``docs (doc_id, text, ...)`` and of edited texts.

    In the edited text the last quarter of the characters gives way to as many,
    or all, of the first of the next document by ``doc_id``; the first follows
    the last. Rows that share a ``doc_id`` follow one another in the order of a
    hash of their texts, equal rows count as one and each is returned. A row
    without ``doc_id`` comes after all others. A null text is empty. An empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    following = checkpoint(_next_documents(docs))
    # an id that is null takes part in joins as a number that its flag tells from others;
    # both joins use the same columns, so that they read one exchange
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64(F.col("doc_id").isNull(), "h").alias("g")]
    docs = with_sketch(docs.select("text", *key), "text", "sketch").select("k", "g", "text", "sketch")
    before = following.select(
        F.coalesce("next_id", F.lit(0)).alias("k"),
        F.xxhash64(F.col("next_id").isNull(), "next_h").alias("g"),
        F.coalesce("doc_id", F.lit(0)).alias("to_k"),
        F.xxhash64(F.col("doc_id").isNull(), "h").alias("to_g"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"),
    )
    heads = docs.join(before, ["k", "g"]).select(
        "to_k", "to_g", F.expr("left(text, quarter)").alias("head"), F.col("sketch").alias("next_sketch")
    )
    heads = heads.groupBy(F.col("to_k").alias("k"), F.col("to_g").alias("g")).agg(
        F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch")
    )
    rows = docs.join(heads, ["k", "g"])
    n = F.char_length("text").cast("long")
    rows = _settled(rows, "edited", F.expr("concat(left(text, cast(char_length(text) - floor(char_length(text) / 4) as int)), head)"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    nameless = F.col("g") == F.xxhash64(F.lit(True), F.xxhash64("text"))
    return rows.select(
        F.when(~nameless, F.col("k")).alias("doc_id"),
        n.alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
