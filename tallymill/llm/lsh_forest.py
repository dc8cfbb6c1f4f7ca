"""MinHash near-duplicates by an LSH forest.

Each text has a label in each of ``TREES`` sorted orders: the smallest values of
six hash functions over its 5-word shingles, three of which make the prefix a
region is entered by and three the order inside it. Texts that share a prefix
form a region. A region of more than ``REGION`` texts is entered deeper, by all
six values, and beyond that in salted parts; this is the depth that adapts.

Candidates are neighbours in the sorted order of a region, ``NEIGHBOURS`` to
each side, which have the longest common prefixes, and every text of a region
with the region's leader, the text that agrees most often with the commonest
label of its regions. So a group of thousands of copies makes links that grow
with its size, not with its square. Two texts of similarity 0.75 share no region
with a probability of (1 - 0.75**3)**20, about 2e-5.

Links are confirmed on full shingle sets: first each text with its most similar
candidate, then all candidates between different components, so that no
candidate that could join two components goes unread.

Where a region holds more texts than are paired with each other and they are not
one component by then, its texts go through an exact join, see ``left_pairs``:
so no bound on neighbours, leaders or parts drops a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.components import components
from tallymill.llm.key_filter import KeyFilter, maybe
from tallymill.llm.text_hashes import binaries, chunks, constants, mix, shingles, utf8, word_hashes
from tallymill.session import checkpoint

TREES = 20
DEPTH = 6
#: Bits kept of each smallest hash.
BITS = 21
REGION = 128
NEIGHBOURS = 8
#: Lanes of one byte that estimate a similarity before sets are read, and the
#: estimate below which a candidate is not read: 0.75 is five standard
#: deviations above it.
LANES = 120
FLOOR = 0.55
#: Bits of the filter for the texts whose sets are read; its size is fixed.
FILTER_BITS = 1 << 22
#: Counters for how many texts have a shingle; their number is fixed, and they
#: decide only the order of shingles.
COUNTERS = 1 << 16
#: Texts of a block of the exact join.
BLOCK = 500

_SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, regions array<long>, orders array<long>, lanes binary"


def _label(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function for every non-empty row."""
    values = np.empty((len(rows), TREES * DEPTH), np.uint64)
    for j, (a, b) in enumerate(zip(constants(TREES * DEPTH, 21), constants(TREES * DEPTH, 22))):
        x = hashes * a
        x ^= x >> np.uint64(32)
        values[:, j] = np.minimum.reduceat(x * b, rows)
    return mix(values) >> np.uint64(64 - BITS)


def _sketches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id")
        for first, last in chunks(offsets):
            part = offsets[first : last + 1] - offsets[first]
            words, rows = word_hashes(data[offsets[first] : offsets[last]], part)
            found, rows = shingles(words, rows)
            counts = np.diff(rows)
            n = len(counts)
            full = np.flatnonzero(counts)
            hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            regions = np.zeros((n, TREES), np.uint64)
            orders = np.zeros((n, TREES), np.uint64)
            lanes = np.zeros((n, LANES), np.uint8)
            if len(full):
                hi[full] = np.add.reduceat(mix(found + np.uint64(1)), rows[full])
                lo[full] = np.bitwise_xor.reduceat(mix(found + np.uint64(2)), rows[full])
                label = _label(found, rows[full])
                lanes[full] = (label[:, :LANES] & np.uint64(255)).astype(np.uint8)
                tree = label.reshape(-1, TREES, DEPTH)
                deep = np.uint64(BITS)
                for out, at in ((regions, 0), (orders, 3)):
                    out[full] = (tree[:, :, at] << deep << deep) | (tree[:, :, at + 1] << deep) | tree[:, :, at + 2]
                regions = mix(regions + constants(TREES, 23)[None, :])
            places = pa.array(np.arange(0, (n + 1) * TREES, TREES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, last - first),
                    pa.array(counts.astype(np.int64)),
                    pa.array(hi.view(np.int64)),
                    pa.array(lo.view(np.int64)),
                    pa.ListArray.from_arrays(places, pa.array(regions.reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(places, pa.array(orders.reshape(-1).view(np.int64))),
                    binaries(lanes.reshape(-1), np.arange(0, (n + 1) * LANES, LANES)),
                ],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "regions", "orders", "lanes"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """Number of shingles, identity of the shingle set and labels of each text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketches, _SKETCH)


def _deeper(parts: DataFrame, key) -> DataFrame:
    """Regions of up to REGION texts as they are, the others entered by ``key``."""
    small = parts.where(F.col("n") <= REGION)
    large = parts.where(F.col("n") > REGION).withColumn("key", key).drop("n")
    return small.unionByName(large.join(large.groupBy("key").agg(F.count("*").alias("n")), "key"))


def region_places(representatives: DataFrame) -> DataFrame:
    """The texts of every region that holds more than one, with their number."""
    places = representatives.select(
        "doc_id", F.explode(F.arrays_zip("regions", "orders")).alias("p")
    ).select("doc_id", F.col("p.regions").alias("region"), F.col("p.orders").alias("order"))
    shared = places.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    return checkpoint(places.join(shared, "region"))


def candidates(places: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of texts that are neighbours, or leader and member, in a region."""
    # leaders of the regions whose pairs are not all neighbours
    wide = places.where(F.col("n") > NEIGHBOURS + 1)
    labels = wide.groupBy("region", "order").agg(F.count("*").alias("m"))
    commonest = labels.groupBy("region").agg(F.max(F.struct("m", "order")).alias("top")).select(
        "region", F.col("top.order").alias("common")
    )
    agreed = wide.join(commonest, "region").groupBy("doc_id").agg(
        F.count(F.when(F.col("order") == F.col("common"), 1)).alias("agreed")
    )
    leaders = wide.join(agreed, "doc_id").groupBy("region").agg(
        F.max(F.struct("agreed", (-F.col("doc_id")).alias("id"))).alias("top")
    ).select("region", (-F.col("top.id")).alias("leader"))
    led = wide.join(leaders, "region").select("doc_id", F.col("leader").alias("other"))

    # neighbours
    parts = places.withColumn("key", F.col("region"))
    parts = _deeper(parts, F.xxhash64("region", "order"))
    salts = F.floor(F.col("n") / REGION) + 1
    parts = parts.withColumn(
        "key", F.when(F.col("n") > REGION, F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), salts))).otherwise(F.col("key"))
    )
    after = Window.partitionBy("key").orderBy("order", "doc_id")
    following = F.array(*[F.lead("doc_id", j).over(after) for j in range(1, NEIGHBOURS + 1)])
    near = parts.select("doc_id", following.alias("following")).select(
        "doc_id", F.explode("following").alias("other")
    ).where("other is not null")
    return (
        led.union(near)
        .where("doc_id != other")
        .select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
        .distinct()
    )


def _estimate(batches):
    for batch in batches:
        same = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LANES) for c in ("lanes_a", "lanes_b")]
        alike = (same[0] == same[1]).mean(axis=1)
        keep = pa.array(alike >= FLOOR)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(alike).filter(keep)],
            names=["a", "b", "alike"],
        )


def _set_reader(wanted: KeyFilter):
    def read(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))))
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                part = offsets[first : last + 1] - offsets[first]
                found, rows = shingles(*word_hashes(data[offsets[first] : offsets[last]], part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), binaries(found, rows)], names=["doc_id", "found"]
                )

    return read


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shingle sets of the texts in ``pairs``."""
    ids = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = KeyFilter(ids, FILTER_BITS)
    found = docs.where("doc_id is not null").mapInArrow(_set_reader(wanted), "doc_id long, found binary")
    return checkpoint(found.join(ids.withColumnRenamed("key", "doc_id"), "doc_id", "left_semi"))


def _confirm(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("found_a"), batch.column("found_b"))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= 75 * (len(both) - shared)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(_confirm, "a long, b long")


def _left_texts(places: DataFrame, links: DataFrame) -> DataFrame:
    """Texts, with their components, of the regions that not all pairs were tried in and that are not one component."""
    wide = places.where(F.col("n") > NEIGHBOURS + 1).select("doc_id", "region")
    member = components(links).select(F.col("id").alias("doc_id"), "component")
    wide = wide.join(member, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = wide.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return checkpoint(wide.join(mixed.select("region"), "region", "left_semi").select("doc_id", "component").distinct())


def _counter(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def _counts(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        data, _ = utf8(batch.column("found"))
        total += np.bincount(_counter(np.frombuffer(data.tobytes(), np.uint64)), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


def _prefixes(counts: np.ndarray):
    """The rarest shingles of each set: two linked sets share one of them."""

    def read(batches):
        for batch in batches:
            out = []
            for value in batch.column("found"):
                found = np.frombuffer(value.as_buffer(), np.uint64)
                n = len(found)
                # a partner shares at least 75 of 100 shingles
                first = n - (3 * n + 3) // 4 + 1
                rarest = np.lexsort((found, counts[_counter(found)]))[:first]
                out.append(found[rarest])
            sizes = np.array([len(x) for x in out], np.int64)
            if not sizes.sum():
                continue
            whole = np.repeat(np.arange(len(out)), sizes)
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [batch.column(c).take(pa.array(whole)) for c in ("doc_id", "component", "n")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), *columns, pa.array(places)],
                names=["shingle", "doc_id", "component", "n", "place"],
            )

    return read


def left_pairs(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of ``texts (doc_id, component)`` of different components that may be linked.

    The shingles of all texts have one order, the rare ones first. Two sets
    with a similarity of 0.75 share a shingle among the first quarter of both, and
    behind the first that they share there are enough left in both. This holds
    for any order; one by frequency keeps shingles that many texts share out
    of the quarter. A shingle all of whose texts are one component
    makes no pairs, and one of many texts makes them in blocks.
    """
    sets = sets.join(texts, "doc_id").withColumn("n", (F.octet_length("found") / 8).cast("long"))
    counted = sets.select("found").mapInArrow(_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    given = "shingle long, doc_id long, component long, n long, place long"
    entries = checkpoint(sets.select("doc_id", "component", "n", "found").mapInArrow(_prefixes(counts), given))
    mixed = entries.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), (F.floor(F.count("*") / BLOCK) + 1).alias("blocks")
    ).where("low != high").select("shingle", "blocks")
    entries = entries.join(mixed, "shingle")
    one = entries.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    two = entries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    two = two.select("shingle", "block", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "n", "place")])
    # an overlap of s in a union of n + n_b - s: 100 s >= 75 (n + n_b - s)
    behind = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    pairs = one.join(two, ["shingle", "block"]).where(
        (F.col("doc_id") < F.col("doc_id_b"))
        & (F.col("component") != F.col("component_b"))
        & (F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * 75)
        & (behind * 175 >= (F.col("n") + F.col("n_b")) * 75)
    )
    return pairs.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def near_links(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Confirmed links ``(a, b)`` that connect each component of ``docs``."""
    classes = sketch.where("n_shingles > 0").groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    representatives = sketch.join(classes.select("doc_id"), "doc_id", "left_semi")
    places = region_places(representatives)
    pairs = candidates(places)
    facts = representatives.select("doc_id", "n_shingles", "lanes")
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns]), F.col(side) == F.col(f"doc_id_{side}"))
    fits = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * 75
    pairs = checkpoint(pairs.where(fits).select("a", "b", "lanes_a", "lanes_b").mapInArrow(_estimate, "a long, b long, alike double"))
    sets = _sets(docs, pairs)
    ends = pairs.select("a", "b", "alike").union(pairs.select("b", "a", "alike"))
    best = ends.groupBy("a").agg(F.max(F.struct("alike", (-F.col("b")).alias("other"))).alias("top"))
    other = -F.col("top.other")
    first = best.select(F.least("a", other).alias("a"), F.greatest("a", other).alias("b")).distinct()
    links = checkpoint(_confirmed(first, sets))
    member = components(links)
    open_pairs = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        open_pairs = open_pairs.join(
            member.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left"
        )
    apart = open_pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    links = checkpoint(links.union(_confirmed(apart, sets)))
    texts = _left_texts(places, links)
    if texts.isEmpty():
        return links
    sets = _sets(docs, texts.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    return links.union(checkpoint(_confirmed(checkpoint(left_pairs(texts, sets)), sets)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of near-duplicates of every row of ``docs (doc_id, text, ...)``.

    Returns ``doc_id, n_shingles, component_id, kept``. Texts without words have
    no shingles and are linked with nothing. A null text is empty. Rows that
    share a ``doc_id`` count as one document with the larger set, and the row is
    returned once; rows without ``doc_id`` get a null component and are kept.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = checkpoint(sketches(docs))
    nameless = sketch.where("doc_id is null").select("doc_id", "n_shingles")
    sketch = sketch.where("doc_id is not null")
    links = near_links(docs, sketch)
    member = components(links)
    classes = sketch.where("n_shingles > 0").groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    known = classes.join(member, F.col("class_id") == F.col("id"), "left").select(
        "set_hi", "set_lo", "n_shingles", F.coalesce("component", "class_id").alias("component")
    )
    found = sketch.select("doc_id", "n_shingles", "set_hi", "set_lo").join(known, ["set_hi", "set_lo", "n_shingles"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return found.union(
        nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one document of each component.

    The document with the smallest ``doc_id`` stays. Of rows that share a
    ``doc_id`` one stays; rows without ``doc_id`` all stay. Texts stay where
    they are unless they may be among those that go.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = checkpoint(near_duplicates(docs))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    repeated = found.where(F.col("kept")).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"))
    gone, repeated = checkpoint(gone), repeated.where("n > 1").select("key")
    # one filter, so that no task needs a second Python worker for the texts
    known = KeyFilter(gone.union(repeated).where("key is not null"), FILTER_BITS)
    named = docs.where("doc_id is not null")
    doubtful = maybe(named, known, "doc_id").join(gone.withColumnRenamed("key", "doc_id"), "doc_id", "left_anti")
    return (
        maybe(named, known, "doc_id", False)
        .unionByName(doubtful.dropDuplicates(["doc_id"]))
        .unionByName(docs.where("doc_id is null"))
    )
