"""Importance resampling against brute force, feature by feature."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallymill.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, score int, `a.b` string, rank long"


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target):
    counts = []
    for texts in ([t for _, t in docs], target):
        total = [0] * 10_000
        for text in texts:
            for f in features(text)[1]:
                total[bucket(f)] += 1
        counts.append(total)
    s, t = counts
    many = [sum(s), sum(t)]
    gain = [
        math.floor(1000 * math.log((float(t[b]) + 1) * (many[0] + 10_000.0) / ((float(s[b]) + 1) * (many[1] + 10_000.0))))
        for b in range(10_000)
    ]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words)))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: 25 * len(order) // 100]
    ranks = {id(r): n + 1 for n, r in enumerate(drawn)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéß東12") for _ in range(rnd.randint(1, 7))) for _ in range(150)]

    def prose(n):
        return "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", "\n", "_", "\x7f"]) for _ in range(n))

    docs = [(i, prose(rnd.randint(0, 60))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .,\n"), (503, "word"), (504, "w" * 40_000), (505, "A b " * 3_000), (None, prose(30)), (-7, prose(30).upper())]
    docs += [(600, prose(30))] * 3 + [(700 + i, "the same text " * 10) for i in range(20)] + [(800, "long" * 40 + " " + "ab" * 50)]
    return docs, [prose(40) for _ in range(20)] + [None, ""]


def frames(spark, docs, target):
    table = spark.createDataFrame([(k, t, "i", 5, "x", 1) for k, t in docs], SCHEMA).repartition(3)
    return table, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")


def test_crc_of_joined_bytes():
    rnd = random.Random(4)
    pairs = [(rnd.randbytes(rnd.randint(0, 30)), rnd.randbytes(rnd.choice([0, 1, 5, 64, 65, 66, 130, 1000]))) for _ in range(300)]
    crcs = [np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1)]
    joined = importance.crc_after(*crcs, np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("words, pairs", [(0, 0), (20, 0), (20, 30), (1 << 16, 1 << 17)])
def test_every_feature_falls_into_its_bucket(spark, tables, words, pairs):
    docs, target = frames(spark, *tables)
    head = importance.head_of(docs, words, pairs)
    assert len(head.numbers) <= words and len(head.pairs) <= pairs and (len(head.numbers) > 0) == (words > 0)
    got = {}
    for r in importance.bucketed(docs, head).collect():
        got.setdefault(r.id, []).append((r.n_words, r.n_features, sorted(np.frombuffer(r.features, "<u2").tolist())))
    want = {}
    for k, t in tables[0]:
        w, f = features(t)
        want.setdefault(k, []).append((len(w), len(f), sorted(map(bucket, f))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("ranked", [importance.RANKED, 40])
def test_resample(spark, tables, ranked, monkeypatch):
    monkeypatch.setattr(importance, "RANKED", ranked)
    monkeypatch.setattr(importance, "CHUNK", 2_000)
    out = importance.resample(*frames(spark, *tables))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in out.dtypes} == {"bigint"}
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == brute(*tables)


def test_empty_tables(spark, tables):
    docs, target = frames(spark, *tables)
    assert importance.resample(docs.limit(0), target).count() == 0
    got = sorted((tuple(r) for r in importance.resample(docs, target.limit(0)).collect()), key=repr)
    assert got == brute(tables[0], [])
