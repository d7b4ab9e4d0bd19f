"""The same operators on streams: search without state, replay with keyed state for each document."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import Pages
from ..operators.search import find_matches

LOG = "doc_id string, seq long, action string, type string, ids array<string>, to_index int, delta int, pages array<struct<page_id:string,source_id:string,source_index:int,rotation:int>>"
_PAGE = ("page_id", "source_id", "source_index", "rotation")
_OUT = "doc_id string, seq long, pages string"
_LISTS = "page_id array<string>, source_id array<string>, source_index array<int>, rotation array<int>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_search(pages: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    return find_matches(pages, query, regex, case_sensitive)


def _op(text: str) -> list:
    x = json.loads(text)
    return [x.get("type"), x.get("ids") or [], x.get("to_index"), x.get("delta"), [[p.get(c) for c in _PAGE] for p in x.get("pages") or ()]]


#: Operations in one entry of the state, entries held in memory at once, and rows that wait in memory before they wait on disk.
_BLOCK, _BLOCKS_HELD, _ROWS_HELD = 128, 64, 8_192


class _Operations:
    """One document's operations by place from 1, in blocks that are read once and written once for a batch."""

    def __init__(self, state) -> None:
        self.state = state
        self.blocks: dict[int, list] = {}
        self.changed: set[int] = set()

    def _block(self, n: int) -> list:
        if n not in self.blocks:
            if len(self.blocks) >= _BLOCKS_HELD:
                self.write()
                self.blocks.clear()
            self.blocks[n] = json.loads(self.state.getValue((n,))[0])
        return self.blocks[n]

    def get(self, place: int) -> list:
        return self._block((place - 1) // _BLOCK)[(place - 1) % _BLOCK]

    def put(self, place: int, op: list) -> None:
        """What was behind it can't be redone any more."""
        n, at = divmod(place - 1, _BLOCK)
        if at == 0:
            if len(self.blocks) >= _BLOCKS_HELD:
                self.write()
                self.blocks.clear()
            self.blocks[n] = [op]
        else:
            self._block(n)[at:] = [op]
        self.changed.add(n)

    def clear(self) -> None:
        self.state.clear()
        self.blocks, self.changed = {}, set()

    def write(self) -> None:
        for n in sorted(self.changed):
            self.state.updateValue((n,), (json.dumps(self.blocks[n]),))
        self.changed.clear()


class _Replay(StatefulProcessor):
    """A document's state: its operations by place in blocks, what is in force and what is undone as two numbers, its pages
    at every ``every``-th place, and the rows that wait for the ones before them. A batch writes the blocks that it changes
    and the numbers once, whatever the order of its rows; a page list is written once for ``every`` operations."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, applied long, undone long, kept long, waiting long")
        self.ops = handle.getMapState("ops", "block long", "ops string")
        self.kept = handle.getMapState("kept", "place long", "pages string")
        self.waiting = handle.getMapState("waiting", "seq long", "row string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = self.head.get()
        next_seq, applied, undone, kept, waiting = head or (0, 0, 0, 0, 0)
        before, now, opened = next_seq, None, head is not None
        ops, lists, held = _Operations(self.ops), {}, {}

        def keep(place: int, pages: list) -> None:
            self.kept.updateValue((place,), (json.dumps(pages),))
            lists.clear()
            lists[place] = pages

        def at(place: int) -> Pages:
            """The pages after the first ``place`` operations, from the last list that was kept before them."""
            base, out = min(place, kept) // self.every * self.every, Pages()
            if base not in lists:
                lists.clear()
                lists[base] = json.loads(self.kept.getValue((base,))[0]) if self.kept.containsKey((base,)) else []
            out.insert(None, lists[base])
            for i in range(base + 1, place + 1):
                out.apply(*ops.get(i))
            return out

        def step(action: str | None, op: list) -> None:
            nonlocal applied, undone, kept, now, opened
            if action == "open":
                if opened:
                    ops.clear()
                    self.kept.clear()
                applied = undone = kept = 0
                now, opened = Pages(), True
                now.insert(None, op[4] or ())
                keep(0, op[4] or [])
            elif action == "apply":
                opened = True
                applied, undone = applied + 1, 0
                while kept >= applied:  # lists of what can't be redone any more
                    self.kept.removeKey((kept,))
                    kept -= self.every
                ops.put(applied, op)
                if now is not None:
                    now.apply(*op)
                if applied % self.every == 0:
                    now = now or at(applied)
                    keep(applied, [r[1:] for r in now.rows()])
                    kept = applied
            elif action == "undo" and applied:
                applied, undone, now = applied - 1, undone + 1, None
            elif action == "redo" and undone:
                applied, undone, now = applied + 1, undone - 1, None

        def wait(seq: int, row: list) -> None:
            nonlocal waiting
            if not (waiting and self.waiting.containsKey((seq,))):
                self.waiting.updateValue((seq,), (json.dumps(row),))
                waiting += 1

        for row in rows:
            if row.seq is None or row.seq < next_seq or row.seq in held:
                continue
            op = _op(row.op)
            if row.seq > next_seq:
                if len(held) < _ROWS_HELD:
                    held[row.seq] = [row.action, op]
                else:
                    wait(row.seq, [row.action, op])
                continue
            step(row.action, op)
            next_seq += 1
            while True:
                if waiting and self.waiting.containsKey((next_seq,)):  # it came first
                    step(*json.loads(self.waiting.getValue((next_seq,))[0]))
                    self.waiting.removeKey((next_seq,))
                    waiting -= 1
                    held.pop(next_seq, None)
                elif next_seq in held:
                    step(*held.pop(next_seq))
                else:
                    break
                next_seq += 1
        for seq, row in held.items():
            wait(seq, row)
        if next_seq > before:
            now = now or at(applied)
        ops.write()
        self.head.update((next_seq, applied, undone, kept, waiting))
        if next_seq > before:
            columns = zip(*(r[1:] for r in now.rows()))
            yield Row(doc_id=key[0], seq=next_seq - 1, pages=json.dumps(dict(zip(_PAGE, columns))))

    def close(self) -> None:
        pass


def stream_replay(log: DataFrame, every: int = 256) -> DataFrame:
    """Each document's manifest after every batch that moves it on, from a stream of ``LOG`` rows whose
    seq counts from 0 in each document. Use output mode update.

    ``open`` sets the first pages. Rows wait for the ones before them, without a bound; repeated and late ones don't
    count. Any number of operations can be undone. What is kept for a document grows with its operations, on
    disk, and a batch reads the last page list before the place it ends at with the ``every`` operations behind it
    at most. A document without pages has no rows. The session's state store becomes the one on RocksDB, which keyed
    state needs."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = log.select("doc_id", "seq", "action", F.to_json(F.struct("type", "ids", "to_index", "delta", "pages")).alias("op"))
    out = rows.groupBy("doc_id").transformWithState(_Replay(every), _OUT, "Update", "None")
    # Operations and page lists cross to Python and back as text, one value for each: rows of nested values cost many times more.
    out = out.select("doc_id", "seq", F.from_json("pages", _LISTS).alias("p"))
    out = out.select("doc_id", "seq", F.posexplode(F.arrays_zip(*(F.col(f"p.{c}").alias(c) for c in _PAGE))).alias("n", "page"))
    return out.select("doc_id", "seq", (F.col("n") + 1).alias("position"), "page.*")
