"""Pieces, leaks, toxicity, page text and neighbours against plain Python and libraries."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe.llm import pieces
from folioframe.llm.ann import Settings, nearest_neighbours
from folioframe.llm.decontam import Alignment, align, drop_contaminated, leak_rows, leaks
from folioframe.llm.html_extract import extract, main_text
from folioframe.llm.toxicity import Settings as ToxicSettings
from folioframe.llm.toxicity import score_toxicity

TEXTS = ["", " ", "  a  b ", "x\ny\n\n z", "日本語テキスト🙂", "tab\tx", "▁ mark ▁▁", "The quick, brown fox's den.", "\u0000null", "é" * 2000, "word " * 30000, None, "the theory of the then"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_are_the_librarys(spark, library):
    held = pieces.load(spark)
    rng = random.Random(1)
    made = ["".join(rng.choice(["th", "er", "ing", "on", " ", ",", "é", "2", ".\n"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(t, "clash") for t in TEXTS + made], "text string, ids string")
    out = df.select("text", pieces.encode(F.col("text"), held, chunk_chars=200, cached_words=50).alias("n")).withColumn("back", pieces.decode(F.col("n"), held))
    for r in out.collect():
        assert r.back == r.text
        if r.text is None:
            assert r.n is None
        elif "▁" not in r.text and "\u0000" not in r.text:
            assert list(r.n) == library.encode(r.text)
    both = df.select("text", pieces.encode_and_check(F.col("text"), held).alias("e")).collect()
    assert all(r.e.same for r in both)
    assert df.limit(0).select(pieces.encode(F.col("text"), held)).count() == 0


def best_splits(word, scores, raw):
    """The best score of all ways to cut a word, and those ways."""
    best, ways = [0.0], [[[]]]
    for end in range(1, len(word) + 1):
        options = [(best[start] + scores[word[start:end]], start, word[start:end]) for start in range(end) if word[start:end] in scores]
        options.append((best[end - 1] + raw, end - 1, None))
        top = max(o[0] for o in options)
        best.append(top)
        ways.append([w + [p] for score, start, p in options if score == top for w in ways[start]])
    return best[-1], ways[-1]


def test_words_are_kept_by_their_characters():
    words, rng = pieces.Vocabulary.read(pieces.MODEL), random.Random(2)
    texts = pd.Series([" ".join("".join(rng.choices("abcdef0123456789", k=2_000)) for _ in range(3)) + f" the word {i}" for i in range(60)])
    plain = [ids.tolist() for part in pieces._encoded(texts, words, 6_000, 10**6, 10**9) for ids in part]
    few = pieces.Vocabulary.read(pieces.MODEL)
    bounded, most = [], 0
    for part in pieces._encoded(texts, few, 6_000, 10**6, 20_000):
        bounded += [ids.tolist() for ids in part]
        most = max(most, sum(map(len, few.young)) + sum(map(len, few.old)))
    assert bounded == plain and most <= 2 * (20_000 + 3 * 6_100) < sum(map(len, words.young))


def test_unigram_scores_take_the_best_path():
    rng = random.Random(11)
    for _ in range(20):
        made = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"▁", "▁a", "▁bc"}
        scores = {p: float(-rng.randint(1, 40)) / 4 - 0.1 for p in sorted(made)}
        vocabulary = pieces.Vocabulary([(p, s, 300 + i) for i, (p, s) in enumerate(scores.items())], list(range(256)), merges=False)
        names = {300 + i: p for i, p in enumerate(scores)}
        words = {"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60)}
        for word, code in vocabulary.encode_words(words).items():
            ids, path = np.frombuffer(code, np.int32).tolist(), []
            while ids:
                if ids[0] >= 300:
                    path.append(names[ids.pop(0)])
                else:
                    size = len(word[sum(len(p or "x") for p in path)].encode())
                    path.append(None)
                    del ids[:size]
            _, ways = best_splits(word, scores, min(scores.values()) - 10)
            assert path in ways


def test_one_word_of_a_million_characters(library):
    import resource

    vocabulary, rng = pieces.Vocabulary.read(), random.Random(5)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", k=1_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    code = vocabulary.encode_words({"▁" + word, "▁" + word[:500_000]})["▁" + word]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert vocabulary.decode(np.frombuffer(code, np.int32).tolist()) == word
    assert np.frombuffer(vocabulary.encode_words({"▁" + word[:3_000]})["▁" + word[:3_000]], np.int32).tolist() == library.encode(word[:3_000])


def plain_smith_waterman(a, b, how):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (how.match if x == y else how.mismatch), row[j] + how.gap, new[j - 1] + how.gap))
        row = new
        best = max(best, *row)
    return best


def test_alignment():
    rng, how = random.Random(3), Alignment()
    items = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 15))]) for _ in range(50)]
    texts = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 25))]) for _ in range(50)]
    assert [s for s, _ in align(items, texts, how)] == [plain_smith_waterman(a.tolist(), b.tolist(), how) for a, b in zip(items, texts)]


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [passage(40) for _ in range(6)]
    edited = list(items[1])
    for at in (3, 11, 19, 27, 35):
        edited[at] = "edited"
    rows = [(1, " ".join(passage(200) + items[0] + passage(50))), (2, " ".join(passage(30) + edited + passage(30))), (3, " ".join(passage(500))), (4, None), (5, ""), (6, " ".join(items[2][:14])),
            (7, " ".join(passage(30000) + items[3])), (None, " ".join(items[4])), (8, " ".join(items[4]))] + [(100 + i, " ".join(passage(20) + items[5])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(x).title() + "!") for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "w1 w2")], "item_id long, text string")
    for most in (400_000, 50):
        got = {(r.doc_id, r.leak.item_id): r.leak.score for r in df.select("doc_id", F.explode(leaks(df, bench, most_words=most)).alias("leak")).collect()}
        assert got.keys() == {(1, 0), (2, 1), (7, 3), (None, 4), (8, 4)} | {(100 + i, 5) for i in range(60)}
        assert got[1, 0] == 1.0 and 0.7 < got[2, 1] < 1
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert drop_contaminated(df, bench.limit(0)).count() == len(rows) and drop_contaminated(df.limit(0), bench).count() == 0


def test_leaks_are_those_of_aligning_all_pairs(spark):
    """Copies with a fifth to a third of the words replaced, dropped or doubled, beside texts that share common words."""
    rng, how = random.Random(28), Alignment()
    common = [f"c{i}" for i in range(12)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items, rows = [words(rng.randint(12, 45)) for _ in range(24)], []
    for k in range(160):
        text = words(rng.randint(0, 60))
        if k % 4:
            for w in rng.choice(items):
                at = rng.random()
                text += [f"e{k}x{len(text)}"] if at < 0.1 else [] if at < 0.15 else [w, w] if at < 0.2 else [w]
        rows.append((k, " ".join(text + words(rng.randint(0, 60)))))
    want = {}
    for k, text in rows:
        for i, item in enumerate(items):
            score = plain_smith_waterman(item, text.split(), how)
            if score >= how.lowest(len(item)):
                want[k, i] = score / (2 * len(item))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.leak.item_id): r.leak.score for r in df.select("doc_id", F.explode(leaks(df, bench)).alias("leak")).collect()}
    assert len(want) > 80 and not got.keys() - want.keys() and len(got) >= 0.98 * len(want)
    assert all(s == pytest.approx(want[k]) for k, s in got.items())


def test_leaks_in_long_texts_of_one_seed():
    import resource

    import pandas as pd

    from folioframe.llm.decontam import _Items, _search

    item = "a b c " * 10 + " ".join(f"w{i}" for i in range(30))
    items = _Items([(i, item + f" x{i}") for i in range(50)], Alignment())
    texts = pd.Series(["a b c other " + item] * 500 + ["a b c " * 100_000 + item + " x7"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = _search(items, texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    assert all(len(x) == 50 for x in found) and max(found[-1], key=lambda x: x["score"])["item_id"] == 7


def test_leaks_edited_at_every_offset_and_period(spark):
    rng = random.Random(18)
    items, rows = [], []
    for period in (5, 6, 7, 8):
        for offset in range(period):
            words = [f"v{rng.randrange(2000)}" for _ in range(40)]
            edited = [f"edit{i}" if i % period == offset else w for i, w in enumerate(words)]
            rows.append((len(items), "before it " + " ".join(edited) + " after it"))
            # What the edits broke, and no other n-gram, stands in another document too.
            rows.append((1000 + len(items), " xx ".join(" ".join(words[i : i + 3]) for i in range(38) if edited[i : i + 3] != words[i : i + 3])))
            items.append((len(items), " ".join(words)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for docs in (df, df.filter("doc_id < 1000")):
        got = {(r.doc_id, r.leak.item_id): r.leak.score for r in docs.select("doc_id", F.explode(leaks(docs, bench)).alias("leak")).collect()}
        copies = {k: v for k, v in got.items() if k[0] < 1000}
        assert copies.keys() == {(i, i) for i, _ in items} and min(copies.values()) > 0.6


def test_toxicity_finds_new_endings_of_bad_words(spark):
    rng = random.Random(9)
    clean = ["mo" + rng.choice("aeiou") + rng.choice("lrnst") for _ in range(1)] + [a + b + c for a in ("ta", "re", "no") for b in ("li", "mu", "se") for c in ("n", "ra", "to")]
    bad = lambda: "grawl" + "".join(rng.choice("aeioulrnst") for _ in range(3))
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = bad()
            words.append(bad())
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, ""), (1001, "", ""), (None, "taliso grawlena", ""), (1002, "tali " * 30000, "")]
    labels += [(None, 1), (3, None), (2, 0), (2, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = score_toxicity(df, df, given)
    assert scored.columns == df.columns
    out = {r.doc_id: r.score for r in scored.collect()}
    assert len(out) == len({r[0] for r in rows}) and all(0 <= s <= 1 for s in out.values())
    truth = {i: t for i, t in labels if i is not None and t is not None}
    assert all((out[i] >= 0.7) == bool(t) for i, t in truth.items() if __import__("zlib").crc32(str(i).encode()) % 3 == 1)
    assert out[1000] < 0.7 and out[1001] < 0.7 and out[1002] < 0.7
    shuffled = {r.doc_id: r.score for r in score_toxicity(df, df, given, ToxicSettings(broadcast_labels=0)).collect()}
    assert shuffled == pytest.approx(out)
    joined = score_toxicity(df, df, given, ToxicSettings(broadcast_grams=0))
    assert joined.columns == df.columns and {r.doc_id: r.score for r in joined.collect()} == pytest.approx(out, abs=1e-5) and joined.count() == len(rows)
    assert {r.score for r in score_toxicity(df, df, given.limit(0)).collect()} == {0.0}
    assert score_toxicity(df.limit(0), df.limit(0), given).count() == 0


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="home"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies here</div><{0}><h1>Head &amp; line</h1><p>First  para
graph<br>goes on<p>Second &lt;b&gt; <b>bold</b>ly. <aside>Side box of words</aside><ul><li>one<li>two</ul><form><label>Name</label></form>
<div id="comments"><p>A reader comment that is long</p></div></{0}><div class="sidebar"><p>Some more words here</p></div><footer>&copy; me</footer>"""
WANT = "Head & line\nFirst para graph goes on\nSecond <b> boldly.\none\ntwo"


def test_page_text(spark):
    labelled = [(PAGE.format("article").replace("First", f"First {i}"),) for i in range(20)]
    odd = [PAGE.format("div"), PAGE.format("main"), None, "", "<", "plain words alone", "<p" * 3, "<nav>only a menu</nav>", "<article><p>" + "long " * 50000, "<div>" * 3000 + "deep words" + "</div>" * 3000]
    df = spark.createDataFrame([(h, "clash") for h, in labelled + [(o,) for o in odd]], "html string, text string")
    got = [r.t for r in df.select(extract(df).alias("t")).collect()]
    assert got[0] == WANT.replace("First", "First 0")
    by = dict(zip(odd, got[20:]))
    assert by[odd[0]] == by[odd[1]] == WANT
    assert by[None] == by[""] == by["<nav>only a menu</nav>"] == "" and by["plain words alone"] == "plain words alone"
    assert by[odd[8]].count("long") == 50000 and by[odd[9]] == "deep words"
    assert df.limit(0).select(extract(df.limit(0))).count() == 0
    assert main_text(PAGE.format("div"), {}).startswith("Head & line\nFirst para graph goes on\nSecond")


def test_page_text_in_wrappers_and_around_furniture():
    body = "<p>First words of it here</p><p>And the second ones</p>"
    want = "First words of it here\nAnd the second ones"
    names = ("content has-sidebar", "no-sidebar", "with-header", "search-results", "page form tags", "layout has-sidebar", "no-comments", "content-search", "tags", "flex hidden lg:block")
    for name in names:
        for inner in (body, *(f"<{tag}>{body}</{tag.split()[0]}>" for tag in ("article", "main", "div role=main"))):
            page = f"<body class='search has-sidebar'><nav>Home Help</nav><div class='{name}'>{inner}</div><footer>Bye now</footer></body>"
            assert main_text(page, {}) == want, page
    for inner in (body, f"<article>{body}</article>"):
        assert main_text(f"<form id=aspnetForm action=x/><div class=nav>Home all</div>{inner}<div class=footer>bye</div></form>", {}) == want
        assert main_text(f"<body>{inner}<div id=comments><article class=comment><p>{'A reader says more words. ' * 20}</p></article></div>", {}) == want
    assert main_text(f"<div class='no-sidebar'>{body}</div>", {}) == want
    assert main_text(f"<div style='display:none'><article>{body}</article></div>", {}) == ""
    assert main_text(f"<article>{body}<div class=comments><article>Not this one of all the words</article></div></article>", {}) == want
    for block in ("aside", "div class=share-bar"):
        nested = f"<{block}><ul>" + "<li><a href=x>share it all now</a></li>" * 40 + f"</ul></{block.split()[0]}>"
        page = f"<body><article><h1>Six words are in this head</h1>{nested}{body}{nested}<p>Some more at its end</p></article></body>"
        assert main_text(page, {"hint:share": -9.0, "tag:aside": -6.0, "link": -3.0}) == f"Six words are in this head\n{want}\nSome more at its end"


def test_malformed_pages_take_linear_time():
    import time

    pages = ["<a " * 300_000 + '"', "<div>" * 8_000 + "</b>" * 200_000, "<div>" * 100_000 + "</b>" * 100_000, "<div class=ad>" * 70_000 + "x", "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000,
             '<a href="x>y ' * 80_000 + "'", "<b>x " * 200_000, "<" * 1_000_000, "<script>" * 120_000, "<!--" * 250_000, "<li class=ad>x " * 60_000, "<a ='" * 200_000]
    for page in pages:
        began = time.perf_counter()
        main_text(page, {})
        assert time.perf_counter() - began < 20, page[:20]


def test_pages_of_odd_markup():
    assert main_text("<p>a <script>if (a < b) '<p class=\"'</script>b</p>", {}) == "a b"
    assert main_text("<ul><li class=ad>buy this<li>one two<li>three four</ul>", {}) == "one two\nthree four"
    assert main_text("<p>one two three <a href=http://e.org/>y</a> z w v</p>", {}) == "one two three y z w v"
    assert main_text("<article><div class=article-header><h1>A b</h1></div><p>c d</article>", {}) == "A b\nc d"
    assert main_text("<head><title>t</title><p>one two three", {}) == "one two three"


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    vectors = np.concatenate([c + 0.4 * rng.standard_normal((40, 24)) for c in centres]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, vectors[0].tolist()), (901, vectors[0].tolist()), (902, None), (903, [0.0] * 24), (904, [float("nan")] * 24), (905, [1.0, None]), (None, vectors[1].tolist()), (907, [float("inf")] * 24), (908, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    queries = df.filter("vec_id % 20 = 0")
    found = {}
    for r in nearest_neighbours(df, queries, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hits = total = 0
    for q, a in good:
        if q % 20 == 0:
            want = sorted(((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in good if i != q))[:5]
            hits += len({i for _, i in want} & {i for i, _ in found[q]})
            total += 5
            exact = {i: -s for s, i in sorted(((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in good if i != q))}
            assert all(abs(exact[i] - s) < 1e-12 for i, s in found[q]) and len(found[q]) == 5
    assert hits / total >= 0.9
    assert [i for i, _ in found[0]][:2] == [900, 901]
    few = df.filter("vec_id IN (0, 1, 20)")
    tight = nearest_neighbours(few, few, 5, Settings(hashes=6, probes=1, width=0.05))
    assert sorted((r.query_id, r.vec_id) for r in tight.collect()) == [(0, 1), (0, 20), (1, 0), (1, 20), (20, 0), (20, 1)]
    small = nearest_neighbours(df, queries, 5, Settings(group_rows=16))
    assert small.count() == sum(len(x) for x in found.values())
    assert nearest_neighbours(df.limit(0), queries.limit(0), 5).count() == 0


def test_neighbours_in_a_group_of_copies(spark):
    rng = np.random.default_rng(18)
    vectors = rng.standard_normal((400, 12)).astype(np.float32)
    vectors[100:300] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 50 = 0"), 5, Settings(group_rows=32)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found.keys() == set(range(0, 400, 50)) and all(len(x) == 5 for x in found.values())
    assert found[100] == [101, 102, 103, 104, 105] and found[150] == found[200] == found[250] == [100, 101, 102, 103, 104]


def test_neighbours_with_repeated_ids_and_few_cells(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1, vectors[0].tolist())] * 9 + [(2, (vectors[0] * 2).tolist()), (2, vectors[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 50 = 0")
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for settings in (Settings(), Settings(hashes=4, probes=1000), Settings(hashes=2, probes=25), Settings(hashes=5, probes=100, group_rows=64)):
        found = {}
        for r in nearest_neighbours(df, queries, 5, settings).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        hits = 0
        for q in range(0, 300, 50):
            best = {}
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -2), round(cosine(vectors[q], np.array(v)), 12))
            want = sorted(best, key=lambda i: (-best[i], i))[:5]
            assert len(set(found[q])) == 5
            hits += len(set(want) & set(found[q]))
        assert hits >= 27, settings
        assert found[0][:2] == [1, 2]


def test_neighbours_of_very_small_and_very_large_vectors(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(120, 8))
    sizes = [1e-310, 1e-200, 1.0, 1e170, 1e300]
    rows = [(i, [float(x) for x in v * sizes[i % 5]]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 10 < 5"), k=3).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert len(found) == 60
    met = 0
    for q, got in found.items():
        true = sorted(((-float(unit[q] @ unit[j]), j) for j in range(120) if j != q))[:3]
        assert all(abs(s - float(unit[q] @ unit[j])) < 1e-6 for j, s in got)
        met += len({j for _, j in true} & {j for j, _ in got})
    assert met >= 0.9 * 180


def test_many_blocks_of_a_benchmark_find_what_one_does(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(150)] + [(200, None), (201, "")]
    texts = [(i, " ".join([word(), word(), items[rng.randrange(150)][1] if i % 3 == 0 else word(), word()]), "clash", i) for i in range(90)] + [(None, items[5][1], "", 0), (91, None, "", 0), (92, items[5][1], "", 0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, item_id string, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.item_id)
    one, many = (sorted(leak_rows(df, bench, most_words=m).collect(), key=key) for m in (400_000, 2_000))
    assert one == many and len(one) >= 32
    kept, also = (sorted(tuple(r)[3] for r in drop_contaminated(df, bench, most_words=m).collect()) for m in (400_000, 2_000))
    assert kept == also == sorted([*(r[3] for r in texts[:90] if r[0] % 3), 0])
    assert drop_contaminated(df, bench, most_words=2_000).columns == df.columns
    assert leak_rows(df, bench.limit(0)).count() == 0 and drop_contaminated(df, bench.limit(0)).count() == df.count()
