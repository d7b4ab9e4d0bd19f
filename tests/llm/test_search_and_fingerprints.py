"""Fingerprints, hard negatives, ranked search and long conversations against plain Python."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm.chat import format_chats, read_back
from folioframe.llm.fingerprints import edited_fingerprints, fingerprints, likeness, shown
from folioframe.llm.lexical import search, terms_of
from folioframe.llm.negatives import Tree, mine_hard_negatives, products


def test_long_conversations_are_read_back_in_time(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i} [INST] \\ </s>") for i in range(2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = format_chats(df).select(read_back(F.col("formatted")).alias("t"))
    out.collect()
    began = time.time()
    back = out.first().t
    assert time.time() - began < 4
    assert [(r.role, r.text) for r in back] == [(t[2], t[3]) for t in turns]


def words_of(text):
    return collections.Counter(w for w in re.split("[ \t\n\x0b\x0c\r]", (text or "").lower()) if w)


def plain_sample(bag, part, salt):
    """(word, t) of the least a, by the textbook's formulas from the same hashes."""
    long_hash = lambda n: xxhash.xxh64_intdigest((n % 2**64).to_bytes(8, "little"), 42)
    best = None
    for word, weight in bag.items():
        h = long_hash(xxhash.xxh64_intdigest(word.encode(), 42) ^ part ^ salt)
        second = long_hash(h)
        e1, e2, w2 = (-math.log(((x >> 2) + 0.5) * 2.0**-62) for x in (h, second, long_hash(second)))
        c = e1 + e2
        w1 = -math.log(e1 / c)
        r, b = w1 + w2, w2 / (w1 + w2)
        t = math.floor(math.log(weight) / r + b)
        a = c / (math.exp(r * (t - b)) * math.exp(r))
        if best is None or a < best[0]:
            best = (a, word, t)
    return best and best[1:]


def plain_signature(bag, samples=64, seed=42):
    rng = random.Random(seed)
    parts = [rng.getrandbits(62) for _ in range(samples // 8)]
    salts = [0, *(rng.getrandbits(62) for _ in range(7))]
    return [plain_sample(bag, p, s) for p in parts for s in salts]


def test_fingerprints_are_the_textbooks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([3, 40])]) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [None, "", " \n ", texts[0], "Ünï côdé ünï", "a" * 50_000, "long " * 20_000, "x"]
    rows = [(i * 7 % 90, t, f"clash {i}", i) for i, t in enumerate(texts)] + [(None, "no id", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, signature string, bucket int")
    out = {r.doc_id: r for r in edited_fingerprints(df).withColumn("s", shown(F.col("signature"))).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda x: -x[0]) + [(None, "no id")]
    assert len(out) == len(order)
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine, its, next_ = (plain_signature(words_of(t)) for t in (text, edited, after))
        assert out[i].near_edited == sum(a == b for a, b in zip(mine, its)) / 64
        assert out[i].near_next == sum(a == b for a, b in zip(mine, next_)) / 64
        assert len(out[i].s) == 512
    assert len({out[i].s for i, t in order if t == texts[0]}) == 1
    assert edited_fingerprints(df.limit(0)).count() == 0
    alone = edited_fingerprints(df.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_places_agree_as_often_as_the_jaccard_similarity(spark):
    rng = random.Random(5)
    bags = [collections.Counter(rng.choices(range(60), k=200)) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(f"w{w}" for w in b.elements())) for i, b in enumerate(bags)] * 2, "doc_id long, text string")
    a, b = fingerprints(df, samples=800).orderBy("doc_id").collect()
    near = spark.createDataFrame([(a.signature, b.signature)], "a array<int>, b array<int>").select(likeness(F.col("a"), F.col("b")).alias("n")).first().n
    assert near == pytest.approx(sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values()), abs=0.06)


def test_buckets_far_apart_and_one_id_for_many(spark):
    rows = [(10**6 * i, f"text {i} " * 5) for i in range(-40, 40)] + [(5, f"same id {i}") for i in range(200)] + [(None, f"none {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = edited_fingerprints(df).collect()
    assert len(out) == len(rows)
    texts = dict(r for r in rows if r[0] not in (None, 5))
    for r in out:
        below = [i for i in texts if r.doc_id is not None and i < r.doc_id and not (i < 5 <= r.doc_id)]
        if r.doc_id in texts and below:
            t, after = texts[r.doc_id], texts[max(below)]
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()


def mined(rows, k=5, m=10):
    """Brute force over (id, label, whole-number vector)."""
    out = []
    for i, label, v in (r for r in rows if r[0] % 10 == 0):
        score = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for p, j, _ in [s for s in score if s[2] == label][:k]:
            fits = [(-s, n) for s, n, other in score if other != label and 30 * -p <= 100 * -s <= 90 * -p][:m]
            out += [(i, j, at + 1, n, -p, s) for at, (s, n) in enumerate(fits)]
    return sorted(out)


def test_negatives_are_brute_forces(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0.2, 0.4, 6).round(3).tolist()) for i in range(400)]
    rows += [(i, i % 2, [0.5] * 6) for i in range(400, 700)] + [(i, 1, [0.25, 0.5]) for i in range(700, 720)]
    bad = [(None, 1, [0.1] * 6), (800, None, [0.1] * 6), (810, 1, None), (820, 1, [0.1, None]), (830, 1, [float("nan")] * 6), (840, 1, [float("inf")] * 6), (850, 1, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad + rows[:40]], "vec_id long, label int, embedding array<double>, block string")
    found = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=64, queries_at_once=16)
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    assert sorted(map(tuple, found.collect())) == mined(whole)
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_huge_components_and_boxes():
    a = np.array([[2**62, 2**62], [1, -1]], np.int64)
    assert products(a, a).tolist() == [[2**63 - 1, 0], [0, 2]]
    rng = np.random.default_rng(2)
    ids, labels, v = np.arange(1000), rng.integers(0, 4, 1000), rng.integers(-300, 300, (1000, 5))
    tree = Tree(ids, labels, v, leaf_rows=16, fanout=4)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    q = rng.integers(-300, 300, 5)
    low, high = np.array([-(2**63), 1000, 5]), np.array([2**63 - 1, 90_000, 1])
    got = tree.nearest(3, q, 2, False, low, high, np.full(3, -(2**63)), 7)
    scores = sorted(((int(v[i] @ q), i) for i in range(1000) if labels[i] != 2 and i != 3), key=lambda x: (-x[0], x[1]))
    assert got == [[s for s in scores if a <= s[0] <= b][:7] for a, b in zip(low, high)]


PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k):
    bags = [(d, collections.Counter(PATTERN.findall(t.translate(LOWER)))) for d, t in docs if t]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total, length = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for i in sorted({i for i, t in items if i is not None}):
        terms = {t for j, text in items if j == i and text for t in PATTERN.findall(text.translate(LOWER))}
        weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scores = [(sum(w * (10**9 * b[t] // (1000 * b[t] + 20 * (50 + 50 * n * total // length))) for t, w in weights.items() if t in b), d) for d, b, n in bags]
        best = sorted((s for s in scores if s[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, at + 1, d, s) for at, (s, d) in enumerate(best)]
    return out


def test_ranked_search_is_brute_forces(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(60)] + ["É", "日本", "x9"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([4, 63])]).upper() for _ in range(rng.randint(0, 25)))) for i in range(600)]
    docs += [(1000 + i, "t1 t2, t3!") for i in range(300)] + [(None, "t1 t40 t41"), (7, "t50"), (7, "t50"), (2000, None), (2001, ""), (2002, "-- ++"), (2003, "t5 " * 30_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(20)] + [(3, "t59 é"), (40, None), (41, ""), (None, "t1"), (42, "nowhere"), (43, "t1 t2 t3")]
    made = lambda rows, names: spark.createDataFrame([(*r, "clash") for r in rows], names)
    left, right = made(docs, "doc_id long, text string, score string"), made(items, "item_id long, text string, terms string")
    expected = ranked(docs, items, 8)
    assert sorted(map(tuple, search(left, right, k=8, block_docs=100).collect())) == expected
    assert sorted(map(tuple, search(left, right, k=8, group_terms=20).collect())) == expected
    assert search(left.limit(0), right).count() == 0 and search(left, right.limit(0)).count() == 0


def test_terms_of_bytes_are_those_of_characters():
    text = "A-b_Cé x y1\u0085z [Q] \u0000k日本.語"
    assert [t.decode() for t in terms_of(text)] == PATTERN.findall(text.translate(LOWER))
