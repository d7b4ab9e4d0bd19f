import random
import re

import pytest

from folioframe.functions.regex import build_matcher, group_number, invalid_regex, widen
from folioframe.operators import search as T
from folioframe.operators import selection as L


def hits(spark, texts, query, **how):
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    return sorted((r.page, r.start, r.end) for r in T.find_matches(pages, query, **how).collect())


@pytest.mark.parametrize(
    ("texts", "query", "how", "want"),
    [
        (["Hello world hello", "Goodbye HELLO there"], "hello", {}, [(1, 0, 5), (1, 12, 17), (2, 8, 13)]),
        (["abc"], "", {}, []),
        (["abc"], " 　", {}, []),
        (["aaaa"], "aa", {}, [(1, 0, 2), (1, 2, 4)]),
        (["abc a.c"], "a.c", {}, [(1, 4, 7)]),
        (["Hello hello HELLO"], "hello", {"case_sensitive": True}, [(1, 6, 11)]),
        (["order 12 and 345", "no digits here"], r"\d+", {"regex": True}, [(1, 6, 8), (1, 13, 16)]),
        (["abc"], "(", {"regex": True}, []),
        (["baab"], "a*", {"regex": True}, [(1, 1, 3)]),
        ([None, "ÉTÉ été"], "été", {}, [(2, 0, 3), (2, 4, 7)]),
    ],
)
def test_find_matches(spark, texts, query, how, want):
    assert hits(spark, texts, query, **how) == want


def test_offsets_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    for pattern in ("a+", "ab|b", "b*", "(a|b)b"):
        want = []
        for page, text in enumerate(texts, 1):
            at = 0
            while at <= len(text):
                m = re.compile(pattern).search(text, at)
                if not m:
                    break
                if m.end() == m.start():
                    at = m.start() + 1
                    continue
                want.append((page, m.start(), m.end()))
                at = m.end()
        assert hits(spark, texts, pattern, regex=True) == want


def test_matchers(spark):
    assert build_matcher(spark, "   ") is None
    assert invalid_regex(spark, "(", True)
    assert not invalid_regex(spark, "(", False)
    assert not invalid_regex(spark, " ", True)
    assert group_number(r"(a)(?:b)(?<title>c)[(]", "title") == 2
    assert group_number("abc", "title") is None
    assert widen(r"a\s[\s\d]\\s") .count("u3000") == 2


def test_highlight_counts_on_through_items(spark):
    items = spark.createDataFrame([(1, 1, 0, "Hello hello"), (1, 1, 1, "a hello"), (1, 1, 2, "none")], "doc_id long, page int, item_no int, str string")
    marked = {r.item_no: r.marked for r in T.highlight(items, "hello", current=2).collect()}
    plain, now = '<mark class="search-hit">', '<mark class="search-hit" data-current="true">'
    assert marked == {0: f"{plain}Hello</mark> {plain}hello</mark>", 1: f"a {now}hello</mark>", 2: "none"}
    assert {r.marked for r in T.highlight(items, "(", regex=True).collect()} == {"Hello hello", "a hello", "none"}


def test_navigation(spark):
    pages = spark.createDataFrame([(1, 1, "x x"), (1, 4, "x"), (2, 1, "y")], "doc_id long, page int, text string")
    found = sorted(T.with_navigation(T.find_matches(pages, "x")).collect(), key=lambda r: r.hit_no)
    assert [(r.hit_no, r.next_hit, r.prev_hit, r.next_page) for r in found] == [(0, 1, 2, 1), (1, 2, 0, 4), (2, 0, 1, 1)]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r.doc_id: r.active_hit for r in T.active_hit(docs, T.find_matches(pages, "x")).collect()} == {1: 0, 2: -1}
    assert {r.doc_id: r.hits for r in T.count_hits(pages, "x").collect()} == {1: 3, 2: 0}


def test_selection(spark):
    m = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate("abcde")], "doc_id long, position int, page_id string")
    one = lambda p: spark.createDataFrame([(1, p)] if p else [], "doc_id long, page_id string")
    ids = lambda df: sorted(r.page_id for r in df.collect())
    clicks = spark.createDataFrame([(1, 1, "c"), (1, 2, "a")], "doc_id long, seq int, page_id string")
    chosen, anchor = L.toggle(one("a"), clicks)
    assert ids(chosen) == ["c"] and ids(anchor) == ["a"]
    for a, b, want, keeps in (("b", "d", "bcd", "b"), ("d", "a", "abcd", "d"), (None, "c", "c", "c"), ("zz", "c", "c", "c")):
        chosen, anchor = L.select_range(m, one(a), one(b))
        assert ids(chosen) == list(want) and ids(anchor) == [keeps]
    two = spark.createDataFrame([(1, "b"), (1, "d")], "doc_id long, page_id string")
    assert ids(L.collapse_to_single(two, m, one("d"), one("b"))) == ["d"]
    assert ids(L.collapse_to_single(two, m, one("a"), one("d"))) == ["d"]
    assert ids(L.collapse_to_single(two, m, one(None), one(None))) == ["b"]
    assert ids(L.select_all(m)[1]) == ["a"] and L.clear(two).count() == 0
    assert [r.n_selected for r in L.selected_count(two).collect()] == [2]


def test_many_hits_on_one_page(spark):
    import time

    n = 120_000
    page = spark.createDataFrame([(1, 1, 0, "aé " * n)], "doc_id int, page int, item_no int, str string").cache()
    began = time.perf_counter()
    hits = T.find_matches(page.withColumnRenamed("str", "text"), "é")
    found = hits.selectExpr("count(*) AS n", "sum(start) AS starts", "max(end) AS last").first()
    assert (found.n, found.starts, found.last) == (n, sum(3 * i + 1 for i in range(n)), 3 * n - 1)
    row = T.highlight(page, "é", current=7).first()
    assert row.marked == "".join("a<mark class=\"search-hit\"" + (" data-current=\"true\"" if i == 7 else "") + ">é</mark> " for i in range(n))
    assert time.perf_counter() - began < 60


def model_spans(items, found):
    """First and last item of each hit (start, end) of the items' joined text."""
    owner = [i for i, text in enumerate(items) for _ in text or ""]
    return [(a, b, owner[a], owner[b - 1]) for a, b in found]


def test_hits_over_the_borders_of_items(spark):
    import random
    import re

    rng, pages = random.Random(3), {(1, 1): ["a", "aa"], (1, 2): ["", None, "x"], (2, 1): ["ab" * 400, "a", "", "b"]}
    for doc in range(3, 40):
        pages[doc, 1] = ["".join(rng.choice("abA") for _ in range(rng.randint(0, 4))) if rng.random() < 0.9 else None for _ in range(rng.randint(1, 12))]
    rows = [(d, p, i * 3, t, "clash") for (d, p), items in pages.items() for i, t in enumerate(items)]
    df = spark.createDataFrame(rows, "doc_id long, page int, item_no int, str string, k string")
    for query, regex, pattern in (("aa", False, "aa"), ("a+b", True, "a+b"), ("ba", False, "ba")):
        want, marks = [], {}
        for (d, p), items in pages.items():
            text = "".join(t or "" for t in items)
            spans = model_spans(items, [m.span() for m in re.finditer(pattern, text, re.I)])
            want += [(d, p, a, b, i * 3, j * 3, i != j) for a, b, i, j in spans]
            for n, t in enumerate(items):
                at, done = sum(len(x or "") for x in items[:n]), ""
                inside = {c: h for h, (a, b, *_) in enumerate(spans) for c in range(a, b)}
                for c in range(at, at + len(t or "")):
                    h = inside.get(c)
                    if h is not None and (c == at or inside.get(c - 1) != h):
                        done += '<mark class="search-hit" data-current="true">' if h == 1 else '<mark class="search-hit">'
                    done += text[c]
                    if h is not None and (c + 1 == at + len(t) or inside.get(c + 1) != h):
                        done += "</mark>"
                marks[d, p, n * 3] = None if t is None else done
        assert sorted(map(tuple, T.item_spans(df, query, regex).collect())) == sorted(want)
        assert sorted(tuple(r)[:6] for r in T.crossing_hits(df, query, regex).collect()) == sorted(w[:6] for w in want if w[6])
        assert {(r.doc_id, r.page, r.item_no): r.marked for r in T.highlight_across(df, query, 1, regex).collect()} == marks
    assert (1, 1, 0, 2, 0, 3) in {tuple(r) for r in T.crossing_hits(df, "aa").collect()}
    assert T.crossing_hits(df.limit(0), "a").count() == 0
