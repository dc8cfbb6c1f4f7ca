"""Each operator against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import (
    ball_tree, best_fit, compact_windows, line_templates, lsh_forest, mixing, quality, suffix_arrays, syncmers, url_filter,
)
from tallymill.llm import components as comp
from tallymill.llm.queries import URL_RULES, tokenizer
from tallymill.llm.text_hashes import utf8, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, h string, key long"
RND = random.Random(5)
VOCABULARY = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(RND.randint(2, 9))) for _ in range(400)]


def prose(n, rnd):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(lower))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    base = prose(120, rnd)
    near = base.split()
    near[60] = "changed"
    passage = prose(55, rnd)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "One"), (8, "one"), (9, "four words are here"),
        (10, prose(30, rnd) + " " + passage + " " + prose(20, rnd)), (11, prose(5, rnd) + "\n" + passage + "\n" + prose(44, rnd)),
        (12, "x" * 20_000), (13, prose(6_000, rnd)), (14, "same " * 300), (15, "same " * 301), (16, "naïve 東京 don't 100% <|endoftext|> Σας"),
        (17, base.upper()), (-3, prose(40, rnd)), (2**40, prose(40, rnd)),
    ] + [(100 + i, prose(rnd.randint(1, 150), rnd)) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{abs(k) % 4}" if k != 9 else None, 0, "salt", "h", 7) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_tell_words_apart(texts):
    data, offsets = utf8(pa.array([t for _, t in texts]))
    hashes, rows = word_hashes(data, offsets)
    all_words = [w for _, t in texts for w in words(t)]
    assert len(hashes) == len(all_words) and rows[-1] == len(all_words)
    assert len(set(zip(all_words, hashes.tolist()))) == len(set(all_words)) == len(set(hashes.tolist()))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(comp, "PART", 40)
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)] + [(i + 500, i + 501) for i in range(60)] + [(1, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {r["id"]: r.component for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, texts):
    sets = {k: shingle_set(t) for k, t in texts}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == {k: (len(sets[k]), root(k), root(k) == k) for k in sets}
    left = lsh_forest.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k in sets if root(k) == k)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rnd = random.Random(3)
    base = prose(100, rnd).split()
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rnd.randrange(100)] = f"w{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, prose(60, rnd)) for i in range(50)]
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found if r.doc_id < 400} == {0}
    assert all(r.kept for r in found if r.doc_id >= 1000)


def test_links_between_texts_of_a_large_template(spark):
    # a region of the template holds all texts, and few of a text's neighbours there are its partners
    rnd = random.Random(17)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(300):
        own = [f"o{rnd.randrange(10**9)}" for _ in range(40)]
        partner = list(own)
        for at in (5, 11, 17, 23, 29, 35):
            partner[at] = f"p{rnd.randrange(10**9)}"
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + partner))]
    sets = {k: shingle_set(t) for k, t in rows}
    for i in range(300):
        a, b = sets[2 * i], sets[2 * i + 1]
        assert 0.75 <= len(a & b) / len(a | b) < 0.79 and 100 * len(a & sets[(2 * i + 2) % 600]) < 75 * len(a | sets[(2 * i + 2) % 600])
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k - k % 2 for k, _ in rows}


def test_near_duplicates_of_repeated_and_nameless_rows(spark, none):
    assert lsh_forest.near_duplicates(none).count() == 0 and lsh_forest.one_of_each(none).count() == 0
    text = prose(30, random.Random(4))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in lsh_forest.one_of_each(rows).collect()) == [0, 1]


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    got = best_fit.pack_documents(docs, tokenizer()).toPandas()
    for k, text in texts:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = got[got.doc_id == k].sort_values("piece")
        assert [i for part in pieces["ids"] for i in part] == ids
        assert list(pieces.start) == list(range(0, len(ids), 2048))
        assert list(pieces.ids_crc32) == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in pieces.start]
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert best_fit.pack_documents(none, tokenizer()).count() == 0


def test_runs_are_best_fit_decreasing():
    rnd = random.Random(6)
    for _ in range(30):
        capacity = rnd.choice([10, 37, 100])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 60) for _ in range(rnd.randint(1, 12))}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [r for r in rooms if r >= length]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else capacity) - length)
        table = best_fit.runs(counts, capacity)
        sequences = defaultdict(list)
        for i, (length, rank, first, offset, each) in enumerate(table):
            end = table[i + 1][1] if i + 1 < len(table) and table[i + 1][0] == length else counts[length]
            for j in range(end - rank):
                sequences[first + j // each].append((offset + j % each * length, length))
        for held in sequences.values():
            held.sort()
            assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]]
        assert sorted(capacity - sum(n for _, n in h) for h in sequences.values()) == sorted(rooms)


def test_mixing(docs, texts, none, spark):
    got = mixing.takes(docs, block=16).toPandas()
    again = mixing.takes(docs.repartition(3), block=16).toPandas()
    columns = ["doc_id", "taken"]
    assert sorted(map(tuple, got[columns].values)) == sorted(map(tuple, again[columns].values))
    size = {k: len(WORD.findall(t or "")) for k, t in texts}
    assert dict(zip(got.doc_id, got["size"])) == size
    assert (got.taken <= 2 * got["size"]).all()
    total = got["size"].sum()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(sums.target.sum() - 1.5 * total) < 1e-6 and (sums.target <= 2 * sums["size"] + 1e-9).all()
    assert (abs(sums.taken - sums.target) <= 1).all()
    # shares that are passed on go by weight: sources in code point order, null last
    weight = dict(zip(sorted(s for s in sums.index if isinstance(s, str)), (5, 2, 1, 5)))
    level = {s: sums.target[s] / w for s, w in weight.items() if sums.target[s] < 2 * sums["size"][s] - 1e-6}
    assert not level or max(level.values()) - min(level.values()) < 1e-6
    mixed = mixing.mixture(docs, block=16)
    assert mixed.columns == docs.columns
    held = mixed.select("doc_id", mixing.size_of(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in held} == {k: v for k, v in zip(got.doc_id, got.taken) if v}
    assert mixing.takes(none).count() == 0 and mixing.mixture(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c", "x")] * 3 + [(None, "d", None)], "doc_id long, text string, source string")
    assert mixing.takes(rows).agg(F.sum("taken")).first()[0] == mixing.mixture(rows).select(F.sum(mixing.size_of(F.col("text")))).first()[0]


def test_quality(spark, none):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        rows.append((i, prose(80, rnd).capitalize() + "." if good else " ".join([rnd.choice(VOCABULARY).upper() + "!!"] * 60)))
        labels.append((i, int(good)))
    rows += [(1000, ""), (1001, None), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(docs, marks).toPandas()
    known = got[got.doc_id.notna()].set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert all(known.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert np.mean([known.predicted[i] == y for i, y in labels if known.held_out[i]]) > 0.95
    kept = {r.doc_id for r in quality.good_documents(docs, marks).collect()}
    assert kept == {None if np.isnan(k) else int(k) for k in got.doc_id[got.predicted == 1]}
    assert quality.quality(none, marks).count() == 0
    assert {r.score for r in quality.quality(docs, marks.limit(0)).collect()} == {0.5}


def test_line_templates(spark, none):
    rnd = random.Random(8)
    rows = []
    for i in range(30):
        lines = [prose(12, rnd), f"Page {i} of the long archive", "Copyright of the great house", prose(9, rnd), ""]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, "a copied text of one line\nand of another line here") for i in range(9)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[0][1]), (203, "x " * 9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_templates.without_recurring_lines(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    firsts = 0
    for i in range(30):
        lines = rows[i][1].split("\n")
        assert by[i]._dropped in (None, [1], [2], [1, 2])
        firsts += 2 - len(by[i]._dropped or [])
        assert by[i].text == "\n".join(x for j, x in enumerate(lines) if j not in (by[i]._dropped or []))
    # each template stays once; the row without an id is a copy of the first text
    assert firsts in (0, 1, 2)
    assert all(by[100 + i]._dropped is None for i in range(9))
    assert by[200].text is None and by[201].text == "" and by[202].text == "\n\n"
    assert line_templates.without_recurring_lines(none).count() == 0


def test_lines_of_mostly_fields_and_short_lines(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(12):
        lines = ["Les.", f"Posted on 2024-05-{i + 10} at 10:{i + 20} by user{i}", "2024 17:03 42", f"Sum {i} {i + 5} {i * 7}", prose(9, rnd), f"And {i}"]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r._dropped for r in line_templates.without_recurring_lines(docs).collect()}
    assert got[0] is None and all(got[i] == [0, 1, 2] for i in range(1, 12))


def test_fingerprints(spark, docs, texts, none):
    ordered = sorted((k, t or "") for k, t in texts)
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for i, (k, text) in enumerate(ordered):
        quarter, following = len(text) // 4, ordered[(i + 1) % len(ordered)][1]
        edited = text[: len(text) - quarter] + following[:quarter]
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[13].near_edited > 0.4 > got[13].near_next
    assert syncmers.edited_fingerprints(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in syncmers.edited_fingerprints(rows).collect()) == [0, 1, 1]
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert syncmers.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_anchors_do_not_depend_on_their_surroundings(spark):
    rnd = random.Random(9)
    passage = prose(60, rnd)
    rows = [(0, passage), (1, prose(17, rnd) + " " + passage + " " + prose(5, rnd))]
    anchors = [{(a.position, a.hash) for a in r.anchors} for r in syncmers.with_anchors(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert anchors[0] and {(p + 17, h) for p, h in anchors[0]} <= anchors[1]


def test_url_filter(spark):
    urls = [
        (1, "http://WWW.Example.ORG/es/1?x"), (2, "https://example.org/en/15"), (3, "http://a.example.com/fr/3#t"), (4, "http://a.com/de/"),
        (5, None), (6, "no scheme"), (7, "http://myorg/x"), (8, "http://org"), (9, "ftp://b.net/A?u://c.org/"), (10, "://x.org/"),
        (11, "http://www.casino-win.example.net/en/9"), (12, "http://quiet-garden.example.net/en/9"), (12, "http://quiet-garden.example.net/en/9"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, URL_RULES).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/15", "example.org/en/1", "block")
    assert got[3] == ("a.example.com", "/fr/3", "com/fr/", "allow") and got[4] == ("a.com", "/de/", "com/de/", "block")
    assert got[5][:3] == ("", "", None) == got[6][:3] and got[7][2] is None and got[8][:3] == ("org", "", None)
    assert got[9][:3] == ("b.net", "/A", None) and got[10] == ("x.org", "/", "org/", "allow")
    assert got[11][3] == "block" and got[12][3] == "allow"
    assert url_filter.judge(pages, URL_RULES).count() == len(urls) and url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def covered(spans, texts):
    out = {k: np.zeros(len(words(t)), bool) for k, t in texts}
    for r in spans:
        out[r.doc_id][r.start : r.stop] = True
    return out


def exact_cover(texts, n=50):
    where = defaultdict(set)
    for k, t in texts:
        w = words(t)
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(k)
    out = {k: np.zeros(len(words(t)), bool) for k, t in texts}
    for k, t in texts:
        w = words(t)
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                out[k][i : i + n] = True
    return out


def test_repeated_spans(docs, texts, none):
    got, want = covered(suffix_arrays.repeated_spans(docs).collect(), texts), exact_cover(texts)
    assert all((got[k] == want[k]).all() for k in want) and want[10].any()
    assert suffix_arrays.repeated_spans(none).count() == 0


def test_repeated_spans_around_a_frequent_phrase(spark):
    rnd = random.Random(12)

    def fresh(n):
        return [f"w{rnd.randrange(10**9)}" for _ in range(n)]

    phrase, rows = fresh(30), []
    for i in range(30):
        left, right = fresh(10), fresh(10)
        for held in 2 * [left + phrase + right] + 8 * [phrase + right] + 8 * [left + phrase]:
            rows.append((rnd.randrange(10**12), " ".join(fresh(40) + held + fresh(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = covered(suffix_arrays.repeated_spans(docs).collect(), rows), exact_cover(rows)
    assert all((got[k] == want[k]).all() for k in want) and sum(w.any() for w in want.values()) == 60


def test_near_passages(docs, texts, none):
    spans = compact_windows.near_passages(docs).collect()
    got, want = covered(spans, texts), exact_cover(texts)
    assert all((got[k] | ~want[k]).all() for k in want)
    held = dict(texts)
    for r in spans:
        a, b = (shingle_set(" ".join(words(held[k])[s:e])) for k, s, e in ((r.doc_id, r.start, r.stop), (r.other, r.other_start, r.other_stop)))
        assert len(a & b) >= 0.75 * len(a | b) and min(r.stop - r.start, r.other_stop - r.other_start) >= 50
    clean = {k for k, t in texts if k >= 100 and k < 1000}
    assert not clean & {r.doc_id for r in spans}
    assert compact_windows.near_passages(none).count() == 0


def test_near_passages_behind_texts_that_hold_a_part(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        passage = [f"w{rnd.randrange(10**6)}" for _ in range(50)]
        for j, held in enumerate((passage[:40], passage[10:], passage, passage)):
            before, after = ([f"z{rnd.randrange(10**9)}" for _ in range(30)] for _ in range(2))
            rows.append((j * 100 + i, " ".join(before + held + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.other) for r in compact_windows.near_passages(docs).collect()}
    assert {(200 + i, 300 + i) for i in range(40)} <= got


@pytest.mark.parametrize("size, changed", [(50, 1), (70, 1), (100, 2)])
def test_near_passages_with_a_changed_word(spark, size, changed):
    rnd = random.Random(size)
    rows = []
    for i in range(40):
        passage = [f"w{rnd.randrange(10**9)}" for _ in range(size)]
        copy = list(passage)
        for j in range(changed):
            copy[size * (j + 1) // (changed + 1)] = f"c{rnd.randrange(10**9)}"
        for k, held in ((0, passage), (100, copy)):
            before, after = ([f"z{rnd.randrange(10**9)}" for _ in range(30)] for _ in range(2))
            rows.append((k + i, " ".join(before + held + after)))
    spans = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other): (r.start, r.stop) for r in spans}
    assert set(got) == {p for i in range(40) for p in ((i, 100 + i), (100 + i, i))}
    assert set(got.values()) == {(30, 30 + size)}


def test_a_second_passage_of_a_pair_that_has_one(spark):
    rnd = random.Random(23)
    fresh = lambda n: [f"z{rnd.randrange(10**9)}" for _ in range(n)]
    rows, spans = [], {}
    for i in range(20):
        one, two = fresh(50), fresh(50)
        # text 0 holds too little of the second passage, and has the smallest id
        for k, held in ((0, [two[:42], fresh(58)]), (100, [one, two]), (200, [one, two])):
            parts = [fresh(100), held[0], fresh(100), held[1], fresh(100)]
            rows.append((k + i, " ".join(w for p in parts for w in p)))
    found = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i in range(20):
        assert {(r.start, r.stop) for r in found if (r.doc_id, r.other) == (200 + i, 100 + i)} == {(100, 150), (250, 300)}


def test_a_common_phrase_makes_no_pairs_of_all_its_texts(spark, monkeypatch):
    rnd = random.Random(31)
    fresh = lambda n: [f"z{rnd.randrange(10**9)}" for _ in range(n)]
    phrase, rows = fresh(13), [(10_000 + i, " ".join(fresh(40))) for i in range(20)]
    for i in range(400):
        rows.append((2_000 + i, " ".join(fresh(25) + phrase + fresh(25))))
    for i in range(20):
        # the smallest ids hold too little of the passage
        passage = fresh(20) + phrase + fresh(20)
        for k, held in ((0, passage[8:45]), (100, passage), (200, passage)):
            rows.append((k + i, " ".join(fresh(30) + held + fresh(30))))
    compared, confirmed = [], compact_windows._confirmed

    def counted(docs, pairs):
        compared.append(pairs.count())
        return confirmed(docs, pairs)

    monkeypatch.setattr(compact_windows, "_confirmed", counted)
    found = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other): (r.start, r.stop) for r in found}
    assert got == {p: (30, 83) for i in range(20) for p in ((100 + i, 200 + i), (200 + i, 100 + i))}
    assert sum(compared) < 2_000


def test_the_exact_join_misses_no_link_of_two_classes(spark):
    rnd = random.Random(37)
    fresh = lambda n: [f"z{rnd.randrange(10**9)}" for _ in range(n)]
    rows, linked = [], set()
    for i in range(30):
        passage = fresh(60)
        for k in (0, 1):
            copy = list(passage)
            copy[30 * k] = "changed"
            rows.append((100 * k + i, " ".join(fresh(40) + copy + fresh(40))))
        linked.add((100 + i, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs.select("doc_id", F.lit(0).alias("lo"), F.lit(136).alias("hi"), F.lit(True).alias("open"))
    no_class = spark.createDataFrame([], compact_windows._SPANS)
    sets = compact_windows.checkpoint(compact_windows._wide_sets(docs, wide))
    for nearest in (False, True):
        assert {(r.x, r.y) for r in compact_windows._sharing(sets, no_class, nearest).collect()} == linked
    found = compact_windows.checkpoint(compact_windows._confirmed(docs, compact_windows._sharing(sets, no_class, False)))
    assert {(r.doc_id, r.other) for r in found.collect()} >= linked
    # passages that the first round confirmed make one class of a pair
    assert compact_windows._sharing(sets, found, False).count() == 0


def test_near_passages_of_all_pairs_of_a_cluster(spark):
    rnd = random.Random(41)
    fresh = lambda n: [f"z{rnd.randrange(10**9)}" for _ in range(n)]
    rows, passage = [], fresh(150)
    for i in range(30):
        copy = list(passage)
        if i % 3:
            copy[60 + i] = f"c{i}"
        rows.append((i, " ".join(fresh(30) + copy + fresh(30))))
    # one line again and again needs few distinct shingles
    line = fresh(6)
    rows += [(100 + i, " ".join(fresh(60) + 12 * line + fresh(60))) for i in range(4)]
    spans = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other) for r in spans}
    assert got == {(i, j) for of in (range(30), range(100, 104)) for i in of for j in of if i != j}
    assert len(set(spans)) == len(spans)


def test_cells_of_many_texts_find_the_pairs_that_share_enough(monkeypatch):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 5_000, 200)
    number = [np.where(rnd.random(200) < rnd.choice([0.1, 0.5, 0.9]), base, rnd.integers(0, 5_000, 200)) for _ in range(60)]
    ids, side = rnd.permutation(60), np.arange(60) % 2
    for table, frequent in ((1 << 20, 24), (90, 3)):
        monkeypatch.setattr(compact_windows, "TABLE", table)
        monkeypatch.setattr(compact_windows, "FREQUENT", frequent)
        for sides in (side * 0, side):
            got = set(zip(*(x.tolist() for x in compact_windows._alike(sides, ids, number, 5_000))))
            for i in range(60):
                for j in range(i + 1, 60):
                    shared = max(np.isin(number[i], number[j]).sum(), np.isin(number[j], number[i]).sum())
                    assert shared < 34.5 or (i, j) in got or (sides.any() and sides[i] == sides[j])
            assert len(got) < 900 and all(sides[i] != sides[j] or not sides.any() for i, j in got)


def test_places_of_dense_stretches_and_of_classes():
    rnd = np.random.default_rng(8)
    for share in (0.3, 0.7, 0.8, 0.95):
        shared = rnd.random(160) < share
        want = np.zeros(160, bool)
        for a in range(160):
            for b in range(a + compact_windows.LEAST, 161):
                if shared[a:b].sum() * 4 >= (b - a) * 3:
                    want[a:b] = True
        assert not (want & ~compact_windows.dense_places(shared)).any()
    assert not compact_windows.dense_places(np.arange(200) % 60 < 13).any()
    spans = [{"start": 10, "stop": 70, "class": 5}, {"start": 90, "stop": 150, "class": 5}, {"start": 300, "stop": 360, "class": 6}]
    got = compact_windows.class_of_places(400, 0, spans)
    # the first gap is too short for a passage, the second is not, the last is
    assert (got[:146] == 5).all() and (got[146:300] == 0).all() and (got[300:356] == 6).all() and (got[356:] == 6).all()


def test_compact_windows_hold_every_subsequence():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 60, 200).astype(np.uint64)
    rows = np.array([0, 90, 90, 95, 200])
    lo, hi, least = compact_windows.compact_windows(values, rows)
    for a, b in zip(rows[:-1], rows[1:]):
        for i in range(a, b - compact_windows.LEAST + 1):
            for j in range(i + compact_windows.LEAST - 1, b):
                m = values[i : j + 1].min()
                assert any(least[w] == m and lo[w] <= i and hi[w] >= j for w in range(len(lo)))


@pytest.mark.parametrize("shard, block", [(8192, 4096), (40, 2)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "BLOCK", block)
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=6).round(2)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, []), (None, [1.0] * 6), (2400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ball_tree.top_k(df, 10, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    live = [(k, np.floor(1024 * np.array(v))) for k, v in rows if k is not None and k < 2000]
    for q, x in live:
        if q % 100 == 0:
            best = sorted((-int(x @ v), k) for k, v in live if k != q)[:10]
            assert got[q] == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert set(got) == {q for q, _ in live if q % 100 == 0}
    assert ball_tree.top_k(df.limit(0), 10, 100).count() == 0


def test_lines_of_very_long_texts_and_clashing_names(spark):
    """No line carries its text, and looking a line up does not depend on how many are dropped."""
    schema = "doc_id long, text string, `a.b` int, _dropped string, row int, drop_id long, bits string, positions int, h int"
    shared = [f"recurring line number {i} of all texts" for i in range(300)]
    rows = []
    for k in range(6):
        own = [f"w{k}x{i} only here y{k}z{i}" for i in range(20_000)]
        own[::70] = (shared * 2)[: len(own[::70])]
        rows.append((k, "\n".join(own), k, "kept?", 1, 2, "b", 3, 4))
    rows += [(10, None, 7, "x", 1, 2, "b", 3, 4), (None, "a line of its own\n\nx", 8, "x", 1, 2, "b", 3, 4)]
    out = line_templates.without_recurring_lines(spark.createDataFrame(rows, schema).repartition(2))
    assert out.columns == ["doc_id", "text", "a.b", "row", "drop_id", "bits", "positions", "h", "_n_lines", "_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[10].text, got[10]["a.b"], got[10]._n_lines, got[None].text) == (None, 7, 0, "a line of its own\n\nx")
    for k, text, *_ in rows[1:6]:
        lines = text.split("\n")
        kept = [line for i, line in enumerate(lines) if i not in set(got[k]._dropped)]
        assert got[k].text.split("\n") == kept and got[k]._n_lines == 20_000
        assert not any(line.startswith("recurring") for line in kept)
    # the first place of each recurring line stays
    assert sum(line.startswith("recurring") for line in got[0].text.split("\n")) > 0
