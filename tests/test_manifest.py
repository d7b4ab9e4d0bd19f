"""Golden cases and a plain model of manifests and edit logs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioframe.functions import scalars
from folioframe.operators import history as E
from folioframe.operators import manifest as M

SCHEMA = "doc_id long, position int, page_id string, source_id string, source_index int, rotation int"


def manifest(spark, ids, doc=1, rotations=None):
    rows = [(doc, i + 1, p, "A", i, (rotations or {}).get(p, 0)) for i, p in enumerate(ids)]
    return spark.createDataFrame(rows, SCHEMA)


def pages(df, doc=1):
    rows = sorted((r for r in df.collect() if r.doc_id == doc), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    return [r.page_id for r in rows]


def test_rotation_rounds_halves_up(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 360, 450, -90, -360, 44, 45, -45, -46)], "d int")
    got = [r[0] for r in rows.select(scalars.normalize_rotation(F.col("d"))).collect()]
    assert got == [0, 0, 90, 270, 0, 0, 90, 0, 270]


def test_initial_pages_of_empty_sources(spark):
    rows = [(1, 0, "s", "a.pdf", 10, 3), (2, 0, "t", "b.pdf", 10, 0), (3, 0, "u", "c.pdf", 10, -1)]
    src = spark.createDataFrame(rows, "doc_id long, source_ord int, source_id string, name string, size_bytes long, num_pages int")
    got = sorted((r.doc_id, r.source_index, r.rotation) for r in M.initial_pages(src).collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]
    merged = {r.doc_id: (r.name, r.num_pages, r.n_sources) for r in M.merged_documents(src.withColumn("doc_id", F.lit(1))).collect()}
    assert merged == {1: ("merged.pdf", 3, 3)}


@pytest.mark.parametrize(("ids", "to", "want"), [(["b"], 0, "bacd"), (["a", "c"], 1, "bacd"), (["a"], 99, "bcda"), (["d"], -5, "dabc"), (["x"], 2, "abcd")])
def test_reorder(spark, ids, to, want):
    moves = spark.createDataFrame([(1, ids, to)], "doc_id long, ids array<string>, to_index int")
    assert pages(M.reorder(manifest(spark, "abcd"), moves)) == list(want)


def test_rotate_delete_insert_extract(spark):
    m = manifest(spark, "abc", rotations={"b": 90})
    t = spark.createDataFrame([(1, "b"), (1, "zz")], "doc_id long, page_id string")
    assert {r.page_id: r.rotation for r in M.rotate(m, t, 90).collect()} == {"a": 0, "b": 180, "c": 0}
    assert pages(M.delete(m, t)) == ["a", "c"]
    assert pages(M.extract(m, t)) == ["b"]
    new = spark.createDataFrame([(1, 1, [("x", "B", 0, 0), ("y", "B", 1, 0)])], "doc_id long, at_index int, pages array<struct<page_id:string,source_id:string,source_index:int,rotation:int>>")
    assert pages(M.insert_pages(m, new)) == list("axybc")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [(r.doc_id, r.error) for r in M.without_pages(docs, m).collect()] == [(2, "no pages")]


@pytest.mark.parametrize(("cuts", "want"), [([3.0], ["ab", "cde"]), ([2.0, 4.0, 99.0, 1.0], ["a", "bc", "de"]), ([1.5], ["abcde"]), ([2.0, 2.9], ["a", "bcde"])])
def test_split(spark, cuts, want):
    b = spark.createDataFrame([(1, c) for c in cuts], "doc_id long, boundary double")
    rows = sorted(M.split(manifest(spark, "abcde"), b).collect(), key=lambda r: r.position)
    parts = {}
    for r in rows:
        parts.setdefault(r.part_no, []).append(r.page_id)
        assert r.part_position == len(parts[r.part_no])
    assert ["".join(parts[k]) for k in sorted(parts)] == want


def test_output_and_geometry(spark):
    m = spark.createDataFrame([(1, 1, "p", "A", 2, 90), (1, 2, "q", "A", 0, 0), (1, 3, "r", "B", 9, 0)], SCHEMA)
    dims = spark.createDataFrame([("A", 0, 210.0, 300.0, 0), ("A", 2, 230.0, 300.0, 90)], "source_id string, source_index int, width double, height double, page_rotate int")
    assert [(r.output_index, r.source_index, r.rotation) for r in sorted(M.output_manifest(m, dims).collect())] == [(0, 2, 180), (1, 0, 0)]
    shown = {r.position: (r.total_rotation, r.width, r.height) for r in M.page_geometry(m, dims).collect()}
    assert shown == {1: (180, 230.0, 300.0), 2: (0, 210.0, 300.0), 3: (0, 230.0, 300.0)}
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted((r.doc_id, r.error) for r in M.output_errors(docs, m, dims).collect()) == [(1, "missing source B"), (2, "no pages")]


def test_sizes_names_and_clamps(spark):
    sizes = spark.createDataFrame([(x,) for x in (0.0, 512.0, 1023.0, 1024.0, 1536.0, 13002342.0, 1024.0**3, 1048575.0, -1.0, float("nan"), float("inf"))], "v double")
    got = [r[0] for r in sizes.select(scalars.format_file_size(F.col("v"))).collect()]
    assert got == ["0 B", "512 B", "1023 B", "1.0 KB", "1.5 KB", "12.4 MB", "1.0 GB", "1024.0 KB", "—", "—", "—"]
    pages_ = spark.createDataFrame([(0.0, 5), (2.9, 5), (9.0, 5), (float("nan"), 5), (3.0, 0), (-2.0, 5)], "p double, n int")
    assert [r[0] for r in pages_.select(scalars.clamp_page(F.col("p"), F.col("n"))).collect()] == [1, 2, 5, 1, 1, 1]
    names = spark.createDataFrame([("a.PDF", 7), (None, 123)], "name string, n int")
    assert [r[0] for r in names.select(scalars.output_name(F.col("name"), scalars.part_suffix(F.col("n")))).collect()] == ["a-07.pdf", "document-123.pdf"]


def model_apply(ps, op):
    kind, ids, to, delta, new = op
    if kind == "rotate":
        return [(p, (r + delta) % 360) if p in ids else (p, r) for p, r in ps]
    rest = [x for x in ps if x[0] not in ids]
    if kind == "delete":
        return rest
    if kind == "reorder":
        at = min(max(to, 0), len(rest))
        return rest[:at] + [x for x in ps if x[0] in ids] + rest[at:]
    at = min(max(to, 0), len(ps))
    return ps[:at] + [(p, 0) for p in new] + ps[at:]


def test_history_and_replay_against_a_model(spark):
    rng = random.Random(5)
    logs, want, flags, first = [], {}, {}, []
    for doc in range(40):
        ids = [f"{doc}-{i}" for i in range(rng.randint(1, 7))]
        first += [(doc, i + 1, p, "A", i, 0) for i, p in enumerate(ids)]
        applied, undone, saved = [], [], 0
        for seq in range(rng.randint(0, 14)):
            action = rng.choice(["apply", "apply", "apply", "undo", "redo", "save"])
            new = [f"n{doc}-{seq}"]
            op = (rng.choice(["rotate", "delete", "reorder", "merge"]), rng.sample(ids, rng.randint(0, len(ids))), rng.randint(-2, 9), rng.choice([90, 180, -90]), new)
            row = (op[0], op[1], op[2], op[3], [(p, "B", 0, 0) for p in new])
            logs.append((doc, seq, action, row))
            if action == "apply":
                applied, undone = [*applied, op], []
            elif action == "undo" and applied:
                undone = [*undone, applied[-1]]
                applied = applied[:-1]
            elif action == "redo" and undone:
                applied = [*applied, undone[-1]]
                undone = undone[:-1]
            elif action == "save":
                saved = len(applied)
        ps = [(p, 0) for p in ids]
        for op in applied:
            ps = model_apply(ps, op)
        want[doc], flags[doc] = ps, (len(applied), len(undone), len(applied) != saved)
    log = spark.createDataFrame(logs, f"doc_id long, seq long, action string, op {E.OP}")
    history = E.resolve_history(log)
    got = {}
    for r in sorted(E.replay_history(spark.createDataFrame(first, SCHEMA), E.operations(log)).collect(), key=lambda r: r.position):
        got.setdefault(r.doc_id, []).append((r.page_id, r.rotation))
    assert got == {d: ps for d, ps in want.items() if ps}
    seen = {x[0] for x in logs}
    assert {r.doc_id: (r.n_applied, r.n_undone, r.unsaved) for r in E.history_flags(history).collect()} == {d: f for d, f in flags.items() if d in seen}


def test_ranges_of_a_log_combine():
    rng = random.Random(12)
    for _ in range(300):
        weights = rng.choice([(3, 2, 2, 1), (1, 4, 4, 0), (0, 1, 1, 0), (5, 6, 1, 1), (1, 1, 8, 0)])
        log = rng.choices(["apply", "undo", "redo", "save"], weights, k=rng.randint(0, 60))
        state = E.Numbers(rng.randint(0, 12), rng.randint(0, 12))
        applied, top = state.applied, state.applied + state.undone
        cuts = sorted(rng.choices(range(len(log) + 1), k=rng.randint(0, 4)))
        for a, b in zip([0, *cuts], [*cuts, len(log)]):
            applied, top = E.Walk.unpacked(E.Walk(log[a:b]).packed())(applied, top)
        for action in log:
            state.step(action)
        assert (applied, top) == (state.applied, state.applied + state.undone), log


def test_blocks_of_pages_are_a_list(spark):
    rng = random.Random(14)
    for wide, n in ((3, 40), (64, 900)):
        pages, plain, fresh = E.Pages(), [], 0
        for step in range(600):
            kind = rng.choice(["rotate", "delete", "reorder", "reorder", "merge", "odd"])
            pages.wide = min(pages.wide, wide)
            ids = rng.sample([p for p, _ in plain], min(len(plain), rng.choice([1, 1, 2, 30]))) + ["unknown", None]
            new = [(f"n{fresh + i}", "B", 0, 0) for i in range(n if step == 0 else rng.choice([0, 1, 5]))]
            fresh += len(new)
            to = rng.randint(-3, len(plain) + 3)
            pages.apply("merge" if step == 0 else kind, ids, to, 90, new)
            plain = model_apply(plain, ("merge" if step == 0 else kind, ids, to, 90, [p for p, *_ in new])) if step == 0 or kind != "odd" else plain
            assert [(r[1], r[4]) for r in pages.rows()] == plain, (kind, ids, to)
            assert pages.length == len(plain)
    big = E.Pages()
    big.insert(None, [(f"p{i}", "A", i, 0) for i in range(10_000)])
    began = time.time()
    for _ in range(100_000):
        big.apply("reorder", [f"p{rng.randrange(10_000)}"], rng.randrange(10_000), None, None)
    assert time.time() - began < 20 and len({r[1] for r in big.rows()}) == 10_000


def test_one_log_over_many_partitions(spark):
    """Documents that begin, end and go on anywhere in the ranges of a log, one of them very long."""
    rng, rows, want = random.Random(13), [], {}
    for doc, n in [("a", 30), ("b", 60_000), ("c", 1), ("d", 9_000), *((f"e{i}", 20) for i in range(50))]:
        state, saved = E.Numbers(), 0
        for seq in range(n):
            # Long stretches of one kind, down to nothing in force and up to nothing undone.
            kinds = {0: (6, 1, 1), 1: (1, 9, 3), 2: (0, 5, 5)}[seq // 700 % 3]
            action = "save" if seq % 97 == 5 else rng.choices(["apply", "undo", "redo"], kinds)[0]
            state.step(action)
            saved = state.applied if action == "save" else saved
            rows.append((doc, seq, action))
        want[doc] = (state.applied, state.undone, saved)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = spark.createDataFrame([*rows, (None, 1, "apply"), ("a", None, "apply")], "doc_id string, seq long, action string")
        got = {r.doc_id: (r.n_applied, r.n_undone, r.saved_len) for r in E.resolve_history(log).collect()}
        parts = E._states(log).select("doc_id", F.spark_partition_id().alias("p")).filter("doc_id = 'b'").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and parts > 4
    assert E.resolve_history(log.limit(0)).count() == 0


def test_replay_with_nulls_and_unknown_operations(spark):
    ops = [(1, 1, "reorder", ["p2", None], 0, None, None), (1, 2, "delete", [None], None, None, None), (1, 3, "rotate", ["p0", "zz"], None, 90, None), (1, 4, "odd", ["p0"], None, None, None),
           (1, 5, "delete", None, None, None, None), (1, 6, "merge", None, None, None, [("m", "B", 3, 90)]), (2, 1, "merge", None, 9, None, [("n", "B", 0, 0)]), (None, 1, "delete", ["p1"], None, None, None)]
    given = spark.createDataFrame(ops, f"doc_id long, seq long, type string, ids array<string>, to_index int, delta int, pages array<{E.PAGE}>")
    out = sorted((r.doc_id, r.position, r.page_id, r.source_index, r.rotation) for r in E.replay(manifest(spark, ["p0", "p1", "p2"]), given).collect())
    assert out == [(1, 1, "m", 3, 90), (1, 2, "p2", 2, 0), (1, 3, "p0", 0, 90), (1, 4, "p1", 1, 0), (2, 1, "n", 0, 0)]
    assert E.replay(manifest(spark, ["a"]).limit(0), given.limit(0)).count() == 0


def test_a_long_log_of_one_document(spark):
    """A hundred thousand rows of one document: nothing grows with the square of its log."""
    log = spark.range(100_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 2, "undo").otherwise("apply").alias("action"),
                                      F.struct(F.lit("rotate").alias("type"), F.array(F.lit("a")).alias("ids"), F.lit(0).alias("to_index"), F.lit(90).alias("delta"), F.lit(None).cast(f"array<{E.PAGE}>").alias("pages")).alias("op"))
    flags = E.history_flags(E.resolve_history(log)).first()
    assert (flags.n_applied, flags.n_undone) == (33_334, 0)
    out = E.replay_history(manifest(spark, ["a", "b"]), E.operations(log)).collect()
    assert sorted((r.page_id, r.rotation) for r in out) == [("a", 33_334 * 90 % 360), ("b", 0)]


def test_array_move(spark):
    rng, rows, moves, want = random.Random(1), [], [], {}
    for doc in range(30):
        n = rng.randint(1, 6)
        items = [f"{i}" for i in range(n)]
        a, b = rng.randint(-1, 7), rng.randint(-1, 7)
        rows += [(doc, i + 1, x, "A", 0, 0) for i, x in enumerate(items)]
        moves.append((doc, a, b))
        if 0 <= a < n and 0 <= b < n:
            items.insert(b, items.pop(a))
        want[doc] = items
    out = M.array_move(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(moves, "doc_id long, from_index int, to_index int"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.position):
        got.setdefault(r.doc_id, []).append(r.page_id)
    assert got == want


def test_pages_that_their_sources_do_not_have(spark):
    rows = [(1, 1, "a", "A", 0, 0), (1, 2, "b", "A", 3, 90), (1, 3, "c", "A", -1, 0), (1, 4, "d", "Z", 0, 0), (2, 1, "e", None, 0, 0), (2, 2, "f", "A", None, 0), (2, 3, "g", "B", 0, 0)]
    sources = spark.createDataFrame([("A", 2), ("A", 3), ("B", None)], "source_id string, num_pages int")
    dims = spark.createDataFrame([("A", 0, 90)], "source_id string, source_index int, page_rotate int")
    found = spark.createDataFrame(rows, SCHEMA)
    errors = {r.page_id: r.error for r in M.page_errors(found, sources).collect()}
    assert errors == {"b": "page 3 of source A with 3 pages", "c": "page -1 of source A with 3 pages", "d": "missing source Z", "e": "missing source null", "f": "page null of source A with 3 pages", "g": "page 0 of source B with 0 pages"}
    out = {r.page_id: (r.output_index, r.rotation) for r in M.output_manifest(found, dims).collect()}
    assert out == {"a": (0, 90), "b": (1, 90), "c": (2, 0), "f": (1, 0)}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {(r.doc_id, r.error) for r in M.output_errors(docs, found, dims, sources).collect()} == {(3, "no pages"), *((r[0], errors[r[2]]) for r in rows if r[2] in errors)}
