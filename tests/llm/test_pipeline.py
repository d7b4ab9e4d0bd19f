"""The toxicity model and the pipeline's stages against plain Python."""

import math
import random
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from folioframe.llm import pieces
from folioframe.llm.similar import drop_similar, shingles
from folioframe.llm.simhash import fingerprint
from folioframe.llm.toxicity import Settings, _grams, held_model, language_models, word_value


def plain_models(rows, order=5, d=0.75):
    """(counts by n-gram, log ratio of a word), from the definition."""
    gram = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        for w in text.split():
            s = f"^{w}$"
            gram[toxic].update((s[max(0, i - order + 1) : i], s[i]) for i in range(1, len(s)))
    keys = set(gram[0]) | set(gram[1])
    levels, below = [], keys
    for k in range(order - 2, -1, -1):
        counts = Counter(((h[-k:] if k else ""), x) for h, x in below)
        levels.append(counts)
        below = set(counts)
    levels.reverse()
    types = len({x for _, x in keys})

    def shared(k, h, x):
        if k < 0:
            return 1 / (types + 1)
        h = h[-k:] if k else ""
        same = {y: n for (g, y), n in levels[k].items() if g == h}
        return (max(same[x] - d, 0) + d * len(same) * shared(k - 1, h, x)) / sum(same.values())

    def value(word):
        total, s = 0.0, f"^{word}$"
        for i in range(1, len(s)):
            h, x = s[max(0, i - order + 1) : i], s[i]
            p = []
            for c in (1, 0):
                same = {y: n for (g, y), n in gram[c].items() if g == h}
                t = sum(same.values())
                back = d * len(same) / t if t else 1.0
                low = shared(order - 2, h, x) if (h, x) in keys else 1.0
                p.append((max(same.get(x, 0) - d, 0) / t if t and (h, x) in keys else 0.0) + back * low)
            total += math.log(p[0] / p[1])
        return total

    return value


def test_language_models(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [(" ".join(rng.choice(words[: 30 if i % 4 else 40]) for _ in range(20)), int(i % 4 == 0)) for i in range(40)]
    model = held_model(*language_models(spark.createDataFrame(rows, "text string, toxic int"), Settings()), Settings())
    plain = plain_models(rows)
    for w in [*words, "abcabc", "zzz", "éé"]:
        assert math.isclose(word_value(model, w), plain(w), abs_tol=1e-4)


def test_language_models_keep_every_n_gram(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(" ".join(word() for _ in range(30)), int(i % 3 == 0)) for i in range(30)]
    model, plain = held_model(*language_models(spark.createDataFrame(rows, "text string, toxic int"), Settings()), Settings()), plain_models(rows)
    grams, slots = lambda w: set(_grams(w, 5)), {}
    words = " ".join(t for t, _ in rows).split()
    for g in set().union(*map(grams, words)):
        slots.setdefault(xxhash.xxh64_intdigest(g, 42) % 2**21, []).append(g)
    shared = {g for found in slots.values() if len(found) > 1 for g in found}
    meeting = [w for w in words if grams(w) & shared]
    assert len(meeting) > 5
    for w in meeting + [word() for _ in range(20)]:
        assert math.isclose(word_value(model, w), plain(w), abs_tol=1e-4)


def test_language_models_learn_all_rows_outside_the_sample(spark, monkeypatch):
    from folioframe.llm import toxicity

    learned = []
    monkeypatch.setattr(toxicity, "language_models", lambda rows, settings: learned.append(rows.count()) or language_models(rows, settings))
    docs = spark.createDataFrame([(i, "some words" + " grawl" * (i % 2)) for i in range(600)], "doc_id long, text string")
    toxicity.score_toxicity(docs, docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"), Settings(fit_rows=20))
    assert learned == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(600)) - 20]


def fixture(spark, folder):
    rng = random.Random(12)
    clean = [a + b + c for a in ("ta", "re", "no", "vi") for b in ("li", "mu", "se", "do") for c in ("n", "ra", "to")]
    words = lambda n: [rng.choice(clean) for _ in range(n)]
    line = lambda: " ".join(words(8))
    items = [" ".join(words(30)) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        body = [line() for _ in range(rng.randint(1, 9))]
        if i % 5 == 0:
            body[0] += " grawl" + "".join(rng.choice("aeioulrnst") for _ in range(3)) + " grawlen"
        rows.append([i, "\n".join(body), "en", f"src{i % 3}", 0])
        labels.append((i, 0, int(i % 5 == 0)))
    repeated = "\n".join(line() for _ in range(4))
    for i in (11, 42, 73):
        rows[i][1] += "\n" + repeated
    long = " ".join(words(600))
    for i in (12, 81):
        rows[i][1] = long
    rows[13][1] = long + "."
    rows[14][1] = items[0]
    rows[16][1] = rows[16][1] + "\n" + items[1]
    rows += [[300, None, None, None, None], [301, "", "en", "s", 0], [None, line(), "en", "s", 1]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def similar_components(texts, least=0.8):
    """The smallest id of each component of texts of a five-word Jaccard similarity of 0.8 or more, and the number of pairs."""
    sets, root, pairs = {i: set(shingles(t).tolist()) for i, t in texts.items()}, {i: i for i in texts}, 0
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                pairs += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}, pairs


@pytest.mark.parametrize(("rows_of_band", "block", "shingles_of_block"), [(1, 1_000, 700), (1, 9, 10**6), (5, 1_000, 10**6)])
def test_texts_of_one_template_and_their_edited_copies(spark, rows_of_band, block, shingles_of_block):
    rng, texts = random.Random(12), {}
    word = lambda: "w" + str(rng.randrange(10**6))
    template = [word() for _ in range(60)]
    for i in range(90):
        texts[i] = template + [word() for _ in range(rng.choice([40, 60, 200]))]
    for i in range(90, 150):
        copy = list(texts[rng.randrange(90)])
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts[i] = copy
    texts = {i: " ".join(t) for i, t in texts.items()}
    want, pairs = similar_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = drop_similar(df, band_rows=rows_of_band, block=block, block_shingles=shingles_of_block)
    assert pairs > 40 and {r.doc_id for r in kept.collect()} == want


def test_stages(spark, tmp_path):
    rows, items = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = stages["toxicity"](spark, docs, str(tmp_path))
    assert step.columns == docs.columns
    held_out = {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    kept = {r.doc_id for r in step.collect()}
    assert held_out & kept == {i for i in held_out if i % 5} and {300, 301, None} <= kept

    seen, want = set(), {}
    for i, text in sorted(((r[0], r[1]) for r in rows if r[0] in kept), key=lambda r: (r[0] is not None, r[0])):
        lines, gone = (text or "").split("\n"), set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            gone |= {at, at + 1, at + 2} if w in seen else set()
            seen.add(w)
        want[i] = None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)
    step = stages["line_dedup"](spark, step, str(tmp_path))
    assert step.columns == docs.columns and {r.doc_id: r.text for r in step.collect()} == want
    assert all(r.n_chars == len(r.text) for r in step.collect() if r.text is not None)

    prints = {i: fingerprint(t) & (2**64 - 1) for i, t in want.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = lambda i: (i is None, i)
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)), key=order)
                root[y] = x
    step = stages["near_dedup"](spark, step, str(tmp_path))
    stay = {find(i) for i in prints}
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == stay and 81 not in stay

    step = stages["decontamination"](spark, step, str(tmp_path))
    plain = lambda t: " ".join((t or "").replace(".", " ").split())
    clean = {i for i in stay if not any(x in plain(want[i]) for x in items)}
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == clean and not {14, 16} & clean

    library = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out.keys() == clean
    for i, r in out.items():
        assert r.ids is None if want[i] is None else list(r.ids) == library.encode(want[i])


def test_empty_documents(spark, tmp_path):
    fixture(spark, str(tmp_path / "full"))
    full = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    full.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_clashing_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(30)
    from pyspark.sql import functions as F

    names = ["score", "h", "fp", "k1", "starts", "leak", "__f", "toxic"]
    docs = docs.select("*", *(F.lit("clash").alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-len(names) :] == names and {r.score for r in docs.collect()} == {"clash"}
