"""Headings and outlines against golden cases and sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions import scalars
from folioframe.operators import headings as H
from folioframe.operators import outline as O
from folioframe.plans.queries import QUERIES, _items


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_titles(spark):
    assert column(spark, ["第１２章", "１.２.３"], scalars.normalize_digits) == ["第12章", "1.2.3"]
    given = ["第 1 章 総則", "1. 1. 1 一般事項", "1. 1 適用範囲", "第1章 総 則", "第1章総則", "1.1適用範囲", "第１章 総則", "  a   b "]
    assert column(spark, given, scalars.normalize_title) == ["第1章 総則", "1.1.1 一般事項", "1.1 適用範囲", "第1章 総則", "第1章 総則", "1.1 適用範囲", "第1章 総則", "a b"]
    assert column(spark, ["第3章 x", "1.10 y", "附則"], scalars.leading_numbers) == [[3.0], [1.0, 10.0], None]
    assert column(spark, ["a ..... 3", "a…", "a ---- 5", "a . . . 1", "1.1 plain"], scalars.is_toc_leader) == [True, True, True, True, False]


def test_headings_of_web_pages_keep_numbers_as_they_stand(spark, tmp_path):
    html = ["<p>x</p><h1>The end. 408 and  more .</h1><h1> 1 . 2 plain</h1>", "<h1>A ..... 3</h1><h1>第 1 章１</h1>", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["html_headings"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.level, r.title) for r in rows) == [(0, 1, "1. 2 plain"), (0, 1, "The end. 408 and more."), (1, 1, "第 1 章１")]


def test_default_patterns(spark):
    compiled = H.compile_patterns(spark, H.DEFAULT_PATTERNS)
    assert [level for _, _, level in compiled] == [3, 2, 1]
    lines = ["第1章 総則", "1.1 適用範囲", "1.1.1 一般事項", "第1章", "第1章　総則", "1.1 2.3 4.5", "12.5", "第1章 総則 ..... 3", "1.1 適用範囲 ------ 5", "これは本文です。", "", None]
    got = column(spark, lines, lambda c: H.match_heading(c, compiled)["level"])
    assert got == [1, 2, 3, 1, 1] + [None] * 7
    assert H.compile_patterns(spark, [{"id": "x", "pattern": "(unclosed", "level": 1, "enabled": True}]) == []
    assert [x[2] for x in H.compile_patterns(spark, [p | {"enabled": p["level"] != 2} for p in H.DEFAULT_PATTERNS])] == [3, 1]


def test_merge_patterns():
    off = {"id": "builtin-section", "pattern": "x", "level": 2, "enabled": False, "builtin": True}
    own = {"id": "own", "pattern": "y", "level": 1, "enabled": True, "builtin": False}
    merged = H.merge_patterns([off, own, {"id": 3}, "junk"])
    assert [p["enabled"] for p in merged] == [True, False, True, True] and merged[-1]["id"] == "own"
    assert H.merge_patterns(None) == H.DEFAULT_PATTERNS


def model_headings(rows):
    """rows: (level, seq or None); the sequential rule, and each accepted one's parent."""
    last, out, stack = {1: None, 2: None, 3: None}, [], []
    for i, (level, seq) in enumerate(rows):
        ok = seq is None or last[level] is None or seq >= last[level]
        if ok and seq is not None:
            last[level] = seq
            for deeper in range(level + 1, 4):
                last[deeper] = None
        out.append(ok)
        if ok:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, i))
    parents, stack = {}, []
    for i, (level, _) in enumerate(rows):
        if out[i]:
            parents[i] = next((j for lv, j in reversed(stack) if lv < level), None)
            stack.append((level, i))
    return out, parents


@pytest.mark.parametrize("pages", [1, 7, 64])
def test_sequence_filter_and_tree_on_random_documents(spark, pages):
    rng, rows, model = random.Random(11), [], {}
    for doc in range(60):
        items = []
        for i in range(rng.randint(1, 30)):
            level = rng.randint(1, 3)
            seq = None if rng.random() < 0.2 else [float(rng.randint(1, 4)) for _ in range(level)]
            items.append((level, seq))
            rows.append((doc, i + 1, 0, level, f"t{i}", seq))
        model[doc] = model_headings(items)
    heads = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, level int, title string, seq array<double>")
    found = H.sequence_filter(heads, pages)
    got = {(r.doc_id, r.page_number): r.accepted for r in found.collect()}
    assert all(got[d, i + 1] == ok for d, (oks, _) in model.items() for i, ok in enumerate(oks))
    manifest = spark.createDataFrame([(d, p, "s", p - 1) for d in range(60) for p in range(1, 31)], "doc_id long, position int, source_id string, source_index int")
    tree = {(r.doc_id, r.source_index): r.parent_id for r in H.build_hierarchy(found.filter("accepted"), manifest, pages).collect()}
    want = {(d, i): None if p is None else f"{d}-{p + 1}-0" for d, (_, parents) in model.items() for i, p in parents.items()}
    assert tree == want


def test_headings_of_one_huge_document_lie_in_many_tasks(spark):
    n = 60_000
    heads = spark.range(n, numPartitions=8).select(
        F.lit("d").alias("doc_id"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("page_number"), (F.col("id") % 4).cast("int").alias("line_no"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int").alias("level"), F.col("id").cast("string").alias("title"), F.array((F.col("id") + F.pmod(F.xxhash64("id"), F.lit(900))).cast("double")).alias("seq"),
    )
    heads = heads.withColumn("seq", F.when(F.col("page_number") % 5 > 0, F.col("seq")))
    rows = [(r.level, r.seq) for r in heads.orderBy("page_number", "line_no").collect()]
    oks, parents = model_headings_fast(rows)
    merges = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be read by one task
    spark.conf.set(merges, "false")
    try:
        found = H.sequence_filter(heads)
        per_task = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset(merges)
    assert {int(r.title): r.accepted for r in found.collect()} == dict(enumerate(oks))
    assert max(per_task) < n / 2
    manifest = spark.range(1, n // 4 + 1).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("position"), F.lit("s").alias("source_id"), (F.col("id") - 1).cast("int").alias("source_index"))
    tree = {int(r.title): (r.parent_id, r.sib_index) for r in H.build_hierarchy(found.filter("accepted"), manifest).collect()}
    assert tree == {i: (None if p is None else f"d-{p // 4 + 1}-{p % 4}", place) for i, (p, place) in parents.items()}


def test_outlines_applied_by_document(spark):
    columns = "doc_id string, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int"
    node = lambda d, n, i, up=None: (d, n, up, i, n, "s", 0)
    existing = spark.createDataFrame([node(d, x, i) for d in "abcd" for i, x in enumerate("xy")], columns)
    generated = spark.createDataFrame([node(d, "g", 0) for d in "abce"] + [node("b", "h", 0, "g")], columns)
    modes = spark.createDataFrame([("a", "replace"), ("a", "append"), ("b", "append"), ("c", None), ("d", "replace"), ("e", "append")], "doc_id string, mode string")
    got = sorted((r.doc_id, r.node_id, r.sib_index) for r in H.apply_outlines(existing, generated, modes).collect())
    assert got == [("a", "g", 0), ("b", "g", 2), ("b", "h", 0), ("b", "x", 0), ("b", "y", 1), ("c", "x", 0), ("c", "y", 1), ("e", "g", 0)]


def model_headings_fast(rows):
    """As ``model_headings``, with each accepted one's parent and place, in one walk."""
    last, latest, oks, parents, children = {1: None, 2: None, 3: None}, {1: None, 2: None, 3: None}, [], {}, {}
    for i, (level, seq) in enumerate(rows):
        ok = seq is None or last[level] is None or seq >= last[level]
        oks.append(ok)
        if not ok:
            continue
        if seq is not None:
            last[level] = seq
            last.update({deeper: None for deeper in range(level + 1, 4)})
        parent = max((latest[above] for above in range(1, level) if latest[above] is not None), default=None)
        parents[i] = parent, children.get(parent, 0)
        children[parent] = children.get(parent, 0) + 1
        latest[level] = i
    return oks, parents


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([("総則", 50.0, 700.0, 12.0), ("第1章", 10.0, 700.0, 12.0)], ["第1章総則"]),
        ([("二行目", 10.0, 680.0, 12.0), ("一行目", 10.0, 700.0, 12.0)], ["一行目", "二行目"]),
        ([("章", 60.0, 692.0, 40.0), ("第1", 10.0, 700.0, 40.0)], ["第1章"]),
        ([("a", 0.0, 10.0, 0.0), ("b", 1.0, 8.0, 0.0), ("c", 2.0, 7.9, 0.0)], ["ab", "c"]),
    ],
)
def test_reconstruct_lines(spark, items, want):
    rows = [("s", 0, i, *x) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "source_id string, source_index int, item_no int, str string, x double, y double, font_size double")
    assert [r.line for r in sorted(H.reconstruct_lines(df).collect(), key=lambda r: r.line_no)] == want


def test_items_of_whole_pages_need_no_shuffle(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"d{d}", p, i, rng.choice(["第1章", "T", "1.1 a", "b "]), float(rng.randint(0, 9)), float(rng.randint(0, 30)), rng.choice([0.0, 9.0, 12.0])) for d in range(6) for p in range(4) for i in range(rng.randint(1, 12))]
    items = spark.createDataFrame(rows, "source_id string, source_index int, item_no int, str string, x double, y double, font_size double")
    pages = items.groupBy("source_id", "source_index").agg(F.collect_list(F.struct("item_no", "str", "x", "y", "font_size")).alias("items"))
    want = sorted(tuple(r) for r in H.reconstruct_lines(items).collect())
    assert sorted(tuple(r) for r in H.lines_of_pages(pages).collect()) == want and len(want) > 50
    manifest = spark.createDataFrame([(d, 3 * p + k, f"d{d}", p) for d in range(5) for p in range(5) for k in range(2)], "doc_id int, position int, source_id string, source_index int")
    compiled = H.compile_patterns(spark, [{"id": "t", "label": "", "level": 1, "enabled": True, "pattern": "^(?<title>(第1章|T).*)"}])
    one, other = (sorted(H.auto_outline(manifest, x, compiled, start_page=2).collect()) for x in (items, pages))
    assert one == other and one
    spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate((1, 199, 200, 201, 450))] + [(9, None), (10, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = QUERIES["lines_reconstruct"](spark, str(tmp_path))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    by_rows = H.reconstruct_lines(_items(spark, str(tmp_path))).select("source_id", "source_index", "line_no", F.md5("line").alias("line"))
    assert sorted(lines.collect()) == sorted(by_rows.collect())


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([("s", 0, 10.0), ("s", 0, 12.0), ("s", 0, 0.0), ("t", 0, 0.0)], "source_id string, source_index int, font_size double")
    assert {r.source_id: r.median for r in H.median_font(df).collect()} == {"s": 12.0, "t": 0.0}


NODES = "doc_id long, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int"


def outline(spark, nested, doc=1):
    rows = []

    def walk(items, parent):
        for i, (name, children) in enumerate(items):
            rows.append((doc, name, parent, i, name, "A", 0))
            walk(children, name)

    walk(nested, None)
    return spark.createDataFrame(rows, NODES)


def nested(df):
    rows = df.collect()

    def below(parent):
        return [(r.node_id, below(r.node_id)) for r in sorted((r for r in rows if r.parent_id == parent), key=lambda r: r.sib_index)]

    return below(None)


TREE = [("a", [("b", [("c", [])]), ("d", [])]), ("e", [])]


def ids(spark, *names):
    return spark.createDataFrame([(1, n) for n in names], "doc_id long, node_id string")


def test_flatten_and_closure(spark):
    flat = O.flatten(outline(spark, TREE))
    rows = sorted(flat.collect(), key=lambda r: r.preorder)
    assert [(r.node_id, r.depth, r.parent_id) for r in rows] == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 1, "a"), ("e", 0, None)]
    assert nested(O.rebuild(flat.withColumn("item_no", F.col("preorder")))) == TREE
    assert sorted(r.node_id for r in O.descendants(flat, ids(spark, "a")).collect()) == ["b", "c", "d"]
    assert sorted(r.node_id for r in O.prune_below(flat, ids(spark, "a")).collect()) == ["a", "e"]
    assert {r.node_id: r.n_descendants for r in O.count_descendants(flat).collect()} == {"a": 3, "b": 1, "c": 0, "d": 0, "e": 0}
    deep = [("d0", [])]
    for i in range(1, 40):
        deep = [(f"d{i}", deep)]
    assert sorted(r.depth for r in O.flatten(outline(spark, deep)).collect()) == list(range(40))
    lost = outline(spark, TREE).withColumn("parent_id", F.when(F.col("node_id") == "b", "c").otherwise(F.col("parent_id")))
    with pytest.raises(ValueError):
        O.flatten(lost)


def test_edits(spark):
    t = outline(spark, TREE)
    new = lambda key, at: spark.createDataFrame([(1, at, "n", "n", "A", 0)], f"doc_id long, {key} string, node_id string, title string, source_id string, source_index int")
    assert nested(O.remove(t, ids(spark, "b"))) == [("a", [("d", [])]), ("e", [])]
    assert nested(O.add_after(t, new("after_id", "b"))) == [("a", [("b", [("c", [])]), ("n", []), ("d", [])]), ("e", [])]
    assert nested(O.add_after(t, new("after_id", None))) == [*TREE, ("n", [])]
    assert nested(O.add_after(t, new("after_id", "zz"))) == TREE
    assert nested(O.add_child(t, new("parent_id", "e"))) == [TREE[0], ("e", [("n", [])])]
    assert nested(O.move_up(t, ids(spark, "d"))) == [("a", [("d", []), ("b", [("c", [])])]), ("e", [])]
    assert nested(O.move_up(t, ids(spark, "b"))) == TREE
    assert nested(O.move_down(t, ids(spark, "a"))) == [("e", []), TREE[0]]
    assert nested(O.indent(t, ids(spark, "d"))) == [("a", [("b", [("c", []), ("d", [])])]), ("e", [])]
    assert nested(O.indent(t, ids(spark, "a"))) == TREE
    assert nested(O.outdent(t, ids(spark, "b"))) == [("a", [("d", [])]), ("b", [("c", [])]), ("e", [])]
    assert nested(O.outdent(O.indent(t, ids(spark, "d")), ids(spark, "d"))) == TREE
    move = lambda n, p, o: spark.createDataFrame([(1, n, p, o)], "doc_id long, node_id string, new_parent string, over_id string")
    assert nested(O.move_subtree(t, move("e", "d", "e"))) == [("a", [("b", [("c", [])]), ("d", [("e", [])])])]
    assert nested(O.move_subtree(t, move("e", None, "a"))) == [("e", []), TREE[0]]


def test_resolve_and_remap(spark):
    raw = spark.createDataFrame([("A", "x", None, 0, "t", "chap1", None), ("A", "y", None, 1, "t", None, 5), ("A", "z", None, 2, "t", None, 99), ("A", "w", None, 3, "t", None, None)], "source_id string, node_id string, parent_id string, sib_index int, title string, dest_name string, dest_ref long")
    names = spark.createDataFrame([("A", "chap1", 2)], "source_id string, name string, ref long")
    refs = spark.createDataFrame([("A", 2, 0), ("A", 5, 3)], "source_id string, ref long, source_index int")
    assert {r.node_id: r.source_index for r in O.resolve_dests(raw, names, refs).collect()} == {"x": 0, "y": 3, "z": None, "w": None}


def model_tour(nodes):
    """(depth, preorder, n_below) of nodes {id: (parent, sib_index)} by walking the tree."""
    children, out, at = {}, {}, 0
    for i, (parent, sib) in nodes.items():
        children.setdefault(parent, []).append((sib, i))
    stack = [(0, i) for _, i in sorted(children.get(None, []), reverse=True)]
    while stack:
        depth, i = stack.pop()
        out[i] = [depth, at, 0]
        at += 1
        stack += [(depth + 1, c) for _, c in sorted(children.get(i, []), reverse=True)]
    order = sorted(out, key=lambda i: out[i][1])
    for n, i in enumerate(order):
        end = n + 1
        while end < len(order) and out[order[end]][0] > out[i][0]:
            end += 1
        out[i][2] = end - n - 1
    return {i: tuple(v) for i, v in out.items()}


def test_trees_of_any_shape_against_a_walk(spark):
    rng, rows, want = random.Random(21), [], {}
    for doc in range(25):
        nodes = {}
        for i in range(rng.randint(1, 40)):
            parent = None if not nodes or rng.random() < 0.2 else rng.choice(list(nodes)[-3:] if doc % 2 else list(nodes))
            nodes[f"n{i}"] = (parent, rng.randint(0, 5))
        rows += [(doc, i, p, s, f"t{i}", "A", 0) for i, (p, s) in nodes.items()]
        want |= {(doc, i): v for i, v in model_tour(nodes).items()}
    df = spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int")
    flat = O.flatten(df).persist()
    assert {(r.doc_id, r.node_id): (r.depth, r.preorder, r.n_below) for r in flat.collect()} == want
    mixed = O.flatten(df, nodes_per_walk=20)  # the larger documents by pointers
    assert {(r.doc_id, r.node_id): (r.depth, r.preorder, r.n_below) for r in mixed.collect()} == want and mixed.schema == flat.schema
    above = {(d, i): p for d, i, p, *_ in rows}
    pairs = set()
    for d, i in above:
        up = above[d, i]
        while up is not None:
            pairs.add((d, up, i))
            up = above[d, up]
    assert {tuple(r) for r in O.closure(flat).collect()} == pairs and O.closure(flat).count() == len(pairs)
    chosen = {(d, i) for d, i in above if rng.random() < 0.15}
    ids = spark.createDataFrame(sorted(chosen) * 2, "doc_id long, node_id string")
    assert {tuple(r) for r in O.descendants(flat, ids).collect()} == {p for p in pairs if p[:2] in chosen}
    below = {(d, i) for d, a, i in pairs if (d, a) in chosen}
    assert {(r.doc_id, r.node_id) for r in O.prune_below(flat, ids).collect()} == set(above) - below
    assert {(r.doc_id, r.node_id) for r in O.remove(df, ids).collect()} == set(above) - below - chosen
    flat.unpersist()


def test_small_outlines_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(O, "_doubled", None)
    rows = [(d, str(i), str(i // 3) if i else None, i % 3, "t", "A", None) for d in range(3) for i in range(7_000)]
    flat = O.flatten(spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int").filter("node_id != '0' OR doc_id < 2").withColumn("parent_id", F.expr("IF(doc_id = 2 AND parent_id = '0', NULL, parent_id)")))
    assert flat.groupBy("doc_id").agg(F.count("*"), F.max("preorder"), F.max("n_below")).orderBy("doc_id").collect() == [(0, 7_000, 6_999, 6_999), (1, 7_000, 6_999, 6_999), (2, 6_999, 6_998, 3_718)]


def test_a_chain_of_fifty_thousand_nodes(spark):
    n = 50_000
    chain = spark.range(n).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"),
        F.lit(0).alias("sib_index"), F.lit("t").alias("title"), F.lit("A").alias("source_id"), F.lit(0).alias("source_index"),
    )
    flat = O.flatten(chain)
    off = flat.filter((F.col("depth") != F.col("node_id").cast("int")) | (F.col("preorder") != F.col("depth")) | (F.col("n_below") != n - 1 - F.col("depth"))).count()
    assert off == 0 and flat.count() == n
    ring = chain.withColumn("parent_id", F.coalesce("parent_id", F.lit(str(n - 1))))
    with pytest.raises(ValueError):
        O.flatten(ring.filter("node_id >= 0").limit(50_000))
