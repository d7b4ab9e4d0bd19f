import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row

from folioframe.operators.headings import DEFAULT_PATTERNS
from folioframe.operators.history import OP, operations, replay_history
from folioframe.sources import commits
from folioframe.sources import intake as S
from folioframe.streaming.streams import LOG, _Replay, stream_replay, stream_search


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_stream_search(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a xa"), (2, 1, "b")], "doc_id long, page int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, page int, text string").parquet(str(tmp_path / "in"))
    assert sorted((r.doc_id, r.start) for r in run(stream_search(stream, "A"), "append", "hits", spark)) == [(1, 0), (1, 3)]


def test_stream_replay_waits_for_gaps(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    page = lambda p: {"page_id": p, "source_id": "A", "source_index": 0, "rotation": 0}
    batches = [
        [{"doc_id": "d", "seq": 0, "action": "open", "pages": [page("a"), page("b"), page("c")]}, {"doc_id": "d", "seq": 2, "action": "apply", "type": "delete", "ids": ["b"]}],
        [{"doc_id": "d", "seq": 1, "action": "apply", "type": "rotate", "ids": ["a"], "delta": 90}, {"doc_id": "d", "seq": 0, "action": "open", "pages": []}],
        [{"doc_id": "d", "seq": 3, "action": "undo"}, {"doc_id": "d", "seq": 4, "action": "apply", "type": "reorder", "ids": ["c"], "to_index": 0}],
    ]
    out = stream_replay(spark.readStream.schema(LOG).json(str(source)))
    q = out.writeStream.outputMode("update").format("memory").queryName("pages").start()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.sql("SELECT * FROM pages ORDER BY seq, position").collect():
        seen.setdefault(r.seq, []).append((r.page_id, r.rotation))
    assert seen == {0: [("a", 0), ("b", 0), ("c", 0)], 2: [("a", 90), ("c", 0)], 4: [("c", 0), ("a", 90), ("b", 0)]}


def replayed(spark, source, batches, name, **more):
    """The manifests of a stream of batches after each of them, by (document, seq)."""
    q = stream_replay(spark.readStream.schema(LOG).json(str(source)), **more).writeStream.outputMode("update").format("memory").queryName(name).start()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.sql(f"SELECT * FROM {name} ORDER BY seq, position").collect():
        seen.setdefault((r.doc_id, r.seq), []).append((r.page_id, r.source_id, r.source_index, r.rotation))
    return seen


def batch_replay(spark, rows):
    """The last manifest of each document by the batch operators."""
    log = [(r["doc_id"], r["seq"], r["action"], (r.get("type"), r.get("ids"), r.get("to_index"), r.get("delta"), [tuple(p.values()) for p in r.get("pages") or ()])) for r in rows if r["action"] != "open"]
    first = [(r["doc_id"], i + 1, *p.values()) for r in rows if r["action"] == "open" for i, p in enumerate(r["pages"])]
    manifest = spark.createDataFrame(first, "doc_id string, position int, page_id string, source_id string, source_index int, rotation int")
    out = {}
    for r in sorted(replay_history(manifest, operations(spark.createDataFrame(log, f"doc_id string, seq long, action string, op {OP}"))).collect(), key=lambda r: r.position):
        out.setdefault(r.doc_id, []).append((r.page_id, r.source_id, r.source_index, r.rotation))
    return out


def test_stream_undoes_two_thousand_operations(spark, tmp_path):
    source, rng = tmp_path / "log", random.Random(8)
    source.mkdir()
    page = lambda p: {"page_id": p, "source_id": "A", "source_index": 0, "rotation": 0}
    rows = [{"doc_id": "d", "seq": 0, "action": "open", "pages": [page(f"p{i}") for i in range(6)]}]
    for i in range(1, 2_301):
        rows.append({"doc_id": "d", "seq": i, "action": "apply", "type": rng.choice(["rotate", "reorder"]), "ids": [f"p{rng.randrange(6)}"], "to_index": rng.randrange(6), "delta": 90})
    rows += [{"doc_id": "d", "seq": i, "action": "undo"} for i in range(2_301, 4_301)]
    rows += [{"doc_id": "d", "seq": i, "action": "redo"} for i in range(4_301, 4_331)]
    rows.append({"doc_id": "d", "seq": 4_331, "action": "apply", "type": "delete", "ids": ["p3"]})
    cuts = [0, 900, 2_301, 3_000, 4_301, 4_331, len(rows)]
    seen = replayed(spark, source, [rows[a:b] for a, b in zip(cuts, cuts[1:])], "undone", every=64)
    for end in cuts[1:]:
        assert seen["d", end - 1] == batch_replay(spark, rows[:end])["d"]


class _Counted:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.calls += 1
            if name in ("get", "update"):
                self.value = key if name == "update" else self.value
                return self.value
            if name == "updateValue":
                self.map[key] = value
            elif name == "removeKey":
                self.map.pop(key, None)
            elif name == "clear":
                self.map.clear()
            return key in self.map if name in ("containsKey", "exists") else self.map.get(key)

        return call


def test_a_batch_in_any_order_writes_few_entries_of_state():
    page = lambda p: {"page_id": p, "source_id": "A", "source_index": 0, "rotation": 0}
    rows = [Row(seq=i, action="apply", op=json.dumps({"type": "rotate", "ids": [f"p{i % 5}"], "delta": 90})) for i in range(400, 0, -1)]
    rows.append(Row(seq=0, action="open", op=json.dumps({"pages": [page(f"p{i}") for i in range(5)]})))
    states, replay = [_Counted() for _ in range(4)], _Replay(256)
    replay.head, replay.ops, replay.kept, replay.waiting = states
    (out,) = replay.handleInputRows(("d",), iter(rows), None)
    assert out.seq == 400 and json.loads(out.pages)["rotation"] == [0] * 5
    assert sum(s.calls for s in states) < 20 and not replay.waiting.map
    late = [Row(seq=402, action="undo", op="{}"), Row(seq=401, action="undo", op="{}")]
    (out,) = replay.handleInputRows(("d",), iter(late), None)
    assert out.seq == 402 and json.loads(out.pages)["rotation"] == [270, 0, 0, 0, 270]


def test_stream_equals_batch_on_mixed_late_and_repeated_rows(spark, tmp_path):
    source, rng, rows = tmp_path / "log", random.Random(9), []
    source.mkdir()
    page = lambda p: {"page_id": p, "source_id": "A", "source_index": 1, "rotation": 0}
    for doc in "abcdef":
        rows.append({"doc_id": doc, "seq": 0, "action": "open", "pages": [page(f"{doc}{i}") for i in range(5)]})
        for seq in range(1, 80):
            kind = rng.choice(["rotate", "delete", "reorder", "merge", "odd"])
            action = rng.choice(["apply", "apply", "undo", "undo", "redo", "save", None])
            rows.append({"doc_id": doc, "seq": seq, "action": action, "type": kind, "ids": rng.sample([f"{doc}{i}" for i in range(5)], 2), "to_index": rng.randrange(-1, 7), "delta": rng.choice([90, -90, 45]), "pages": [page(f"n{doc}{seq}")]})
    sent = rows + [r | {"action": "undo"} for r in rng.sample(rows, 60)]  # repeated ones, changed
    late = [r for r in sent[len(rows) :]]
    first = rows[:]
    rng.shuffle(first)
    seen = replayed(spark, source, [first[:150], first[150:300], first[300:], late, [{"doc_id": None, "seq": 0, "action": "undo"}, {"doc_id": "a", "seq": None, "action": "undo"}]], "mixed", every=4)
    want = batch_replay(spark, rows)
    assert {d: seen.get((d, 79), []) for d in "abcdef"} == {d: want.get(d, []) for d in "abcdef"}


def test_saved_parts(spark, tmp_path):
    rows = [(d, p, f"{d}-{p}", p // 3 + 1, p % 3 + 1) for d in range(20) for p in range(7)]
    parts = spark.createDataFrame(rows, "doc_id long, position int, page_id string, part_no int, part_position int")
    S.save_split(parts, str(tmp_path / "parts"), buckets=4)
    assert sorted(tuple(r) for r in S.load_split(spark, str(tmp_path / "parts")).select(*parts.columns).collect()) == rows
    assert sorted(r.page_id for r in S.load_split(spark, str(tmp_path / "parts"), doc_id=3, part_no=2, buckets=4).collect()) == ["3-3", "3-4", "3-5"]
    assert len(list((tmp_path / "parts").glob("rows-*/bucket=*"))) <= 4
    with pytest.raises(AnalysisException):
        S.save_split(parts, str(tmp_path / "parts"))


def test_sources(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"junk\n%PDF-1.4\r\n... /Encrypt 3 0 R")
    (tmp_path / "y.txt").write_bytes(b"plain")
    found = {r.path.rsplit("/", 1)[-1]: (r.version, r.maybe_encrypted) for r in S.triage(spark, str(tmp_path)).collect()}
    assert found == {"x.pdf": ("%PDF-1.4", True), "y.txt": ("%PDF-1.7", False)}
    assert {r.name for r in S.scan_files(spark, str(tmp_path)).collect()} == {"x.pdf", "y.txt"}
    items = spark.createDataFrame([("s", 0, 2, "b"), ("s", 0, 1, "a"), ("s", 0, 3, None)], "source_id string, source_index int, item_no int, str string")
    assert [r.text for r in S.page_text(items).collect()] == ["ab"]
    df = spark.range(3)
    S.save(df, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        S.save(df, str(tmp_path / "out"))
    S.save(df, str(tmp_path / "out"), overwrite=True)
    assert S.load(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        S.save_extract(df.limit(0), str(tmp_path / "none"))


def test_triage_in_pieces_equals_whole_files(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i in range(60):
        parts = [rng.choice([b"/Encrypt", b"/Encryp", b"%%PDF-1.%d" % i, b"%PDF", b"\r", b"\n", b"\xff\x00", b"text " * rng.randrange(4)]) for _ in range(rng.randrange(9))]
        (tmp_path / "in" / f"a b%20{i}.pdf").write_bytes(b"".join(parts))
    path = str(tmp_path / "in")
    whole = {r.path: (r.length, r.version, r.maybe_encrypted) for r in S.triage_content(spark.read.format("binaryFile").load(path)).collect()}
    full = [x for x in (tmp_path / "in").glob("*.pdf") if x.stat().st_size]  # the listing leaves out empty ones
    assert len(whole) == len(full) and len({v[2] for v in whole.values()}) == 2
    for piece in (1, 3, 8, 50, 16 << 20):
        assert {r.path: (r.length, r.version, r.maybe_encrypted) for r in S.triage(spark, path, piece, 5).collect()} == whole


def test_triage_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "big.pdf", "wb") as file:  # sparse, so it takes no space
        file.write(b"%PDF-1.5\n")
        file.seek((129 << 24) - 3)  # over the border of two pieces, behind the second gigabyte
        file.write(b"/Encrypt")
        file.truncate(size := size + (64 << 20))
    assert [tuple(r)[1:] for r in S.triage(spark, str(tmp_path)).collect()] == [(size, "%PDF-1.5", True)]


def test_a_killed_overwrite_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    S.save(spark.range(3), path)
    failing = spark.range(50, numPartitions=5).selectExpr("IF(id = 49, CAST(raise_error('lost') AS BIGINT), id) AS id")
    with pytest.raises(Exception, match="lost"):
        S.save(failing, path, overwrite=True)
    assert S.load(spark, path).count() == 3 and len(list((tmp_path / "out").glob("rows-*"))) == 1
    # Killed after writing rows, and after beginning a record.
    spark.range(9).write.parquet(f"{path}/rows-dead")
    (tmp_path / "out" / "_commits" / "00000001").write_text("rows-de")
    assert S.load(spark, path).count() == 3
    reader = S.load(spark, path)
    S.save(spark.range(7), path, overwrite=True)
    assert S.load(spark, path).count() == 7 and reader.count() == 3
    assert commits.tidy(spark, path) == []
    assert len(commits.tidy(spark, path, hours=0)) == 2
    assert S.load(spark, path).count() == 7


def test_of_two_writers_one_wins(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(2)

    def beaten(by):
        def write(folder):
            by()
            df.write.parquet(folder)

        return write

    with pytest.raises(AnalysisException, match="meanwhile"):
        commits.save_version(spark, path, False, beaten(lambda: S.save(spark.range(5), path)))
    assert S.load(spark, path).count() == 5
    with pytest.raises(AnalysisException, match="meanwhile"):
        commits.save_version(spark, path, True, beaten(lambda: S.save(spark.range(6), path, overwrite=True)))
    assert S.load(spark, path).count() == 6 and len(list((tmp_path / "out").glob("rows-*"))) == 2
    with pytest.raises(AnalysisException, match="nothing saved"):
        S.load(spark, str(tmp_path / "missing"))
    # Many at once: each number is given to one.
    system, at = commits._hadoop(spark, str(tmp_path / "many"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: commits._claim(spark, system, at, i % 4, f"rows-{i}"), range(32)))
    assert sum(won) == 4


def test_stored_patterns(spark, tmp_path):
    S.save_patterns(spark, DEFAULT_PATTERNS, str(tmp_path / "p"))
    assert S.load_patterns(spark, str(tmp_path / "p")) == [{k: p[k] for k in ("id", "label", "pattern", "level", "enabled", "builtin")} for p in DEFAULT_PATTERNS]
    assert S.load_patterns(spark, str(tmp_path / "missing")) is None
