"""Edit logs: undo and redo, and replay of the operations that stay in force.

Undo and redo are a scan over ranges of the log: maps of the two numbers that a range makes of any start combine, so
one document's log may lie in many partitions. A replay is a fold: Spark partitions rows by document and sorts them, and
a task runs through its rows with the pages of one document at a time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from .manifest import MANIFEST

PAGE = "struct<page_id:string,source_id:string,source_index:int,rotation:int>"
OP = f"struct<type:string,ids:array<string>,to_index:int,delta:int,pages:array<{PAGE}>>"
_STATES = "doc_id string, seq long, action string, n_applied long, n_undone long"
_MAPS = ["part", "at", "doc_id", "map", "applied", "top"]
_PAGES = "doc_id string, position int, page_id string, source_id string, source_index int, rotation int"


def log_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.count("*").alias("n"))


class Walk:
    """What undo and redo make of (applied, T), T being what is applied and what is undone together, for all
    starts at once, as a range of a log doesn't know where it begins.

    With T given, a step of undo or redo is clamp(applied + d, 0, T), and such maps compose: (add, floor, ceiling), of
    which floor and ceiling depend on T, are kept for each T up to the number of steps. The first apply makes
    T = applied, so what follows depends on one number s alone, and applied and T are kept for each s. Starts
    beyond the number of steps never meet an edge and differ by what they differ at the start.
    """

    def __init__(self, actions: list[str | None]) -> None:
        steps = [d for d in ({"apply": 0, "undo": -1, "redo": 1}.get(x) for x in actions) if d is not None]
        applies = [i for i, d in enumerate(steps) if d == 0]
        first = applies[0] if applies else len(steps)
        self.most = most = first
        top = np.arange(most + 1)
        self.add, self.floor, self.ceiling = 0, np.zeros(most + 1, np.int64), top.copy()
        for d in steps[:first]:
            self.add += d
            self.floor, self.ceiling = (np.clip(x + d, 0, top) for x in (self.floor, self.ceiling))
        self.after = None
        if applies:
            # s counts from 1: what is applied right after the first apply.
            undos = sum(d < 0 for d in steps[first:])
            here = np.arange(1, undos + 3)
            top = here.copy()
            for d in steps[first + 1 :]:
                if d == 0:
                    here += 1
                    top = here.copy()
                elif d < 0:
                    np.maximum(here - 1, 0, out=here)
                else:
                    np.minimum(here + 1, top, out=here)
            self.after = here, top

    def __call__(self, applied: int, top: int) -> tuple[int, int]:
        at, over = min(top, self.most), max(0, top - self.most)
        here = min(max(applied + self.add, int(self.floor[at])), int(self.ceiling[at]) + over)
        if self.after is None:
            return here, top
        s, (ends, tops) = here, self.after
        at = min(s, len(ends) - 1)
        return int(ends[at]) + s - at, int(tops[at]) + s - at

    def packed(self) -> bytes:
        return pickle.dumps((self.most, self.add, self.floor, self.ceiling, self.after))

    @classmethod
    def unpacked(cls, data: bytes) -> Walk:
        out = cls.__new__(cls)
        out.most, out.add, out.floor, out.ceiling, out.after = pickle.loads(data)
        return out


_RANGE_ROWS = 2_048


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first document of a partition as maps of ranges of its rows, since it may go on from the partition before;
    the last one's numbers at the end, if it began here."""
    first, doc, n, part = None, None, 0, None
    actions: list[str | None] = []
    state = Numbers()
    for batch in batches:
        maps = []
        for part, d, action in zip(batch["part"].tolist(), batch["doc_id"], batch["action"]):
            if first is None:
                first = d
            if d == first:
                actions.append(action)
                if len(actions) == _RANGE_ROWS:
                    maps.append((part, n, first, Walk(actions).packed(), None, None))
                    actions, n = [], n + 1
            elif d != doc:
                doc, state = d, Numbers()
            if d != first:
                state.step(action)
        yield pd.DataFrame(maps, columns=_MAPS)
    if first is not None:
        rest = [(part, n, first, Walk(actions).packed(), None, None)] + ([(part, n + 1, doc, None, state.applied, state.applied + state.undone)] if doc is not None else [])
        yield pd.DataFrame(rest, columns=_MAPS)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, applied, top): where the first document of each partition stands at its beginning, from one
    document's maps in order."""
    doc, applied, top, last = None, 0, 0, None
    for batch in batches:
        out = []
        for part, _, d, data, end, end_top in batch[_MAPS].itertuples(index=False, name=None):
            if d != doc:
                doc, applied, top, last = d, 0, 0, None
            if data is None:
                applied, top = int(end), int(end_top)
                continue
            if part != last:
                out.append((part, applied, top))
                last = part
            applied, top = Walk.unpacked(data)(applied, top)
        yield pd.DataFrame(out, columns=["part", "applied", "top"])


class Numbers:
    """What is applied, undone and saved after each row."""

    def __init__(self, applied: int = 0, undone: int = 0) -> None:
        self.applied, self.undone = applied, undone

    def step(self, action: str | None) -> None:
        if action == "apply":
            self.applied, self.undone = self.applied + 1, 0
        elif action == "undo" and self.applied:
            self.applied, self.undone = self.applied - 1, self.undone + 1
        elif action == "redo" and self.undone:
            self.applied, self.undone = self.applied + 1, self.undone - 1


def resolve_history(log: DataFrame) -> DataFrame:
    """(doc_id, n_applied, n_undone, saved_len) from log rows (doc_id, seq, action).

    apply pushes and clears what was undone; undo and redo move the last operation between the two
    stacks, or do nothing when there is none; save notes how many are in force. ``operations`` has
    the stacks themselves. Rows without a doc_id or a seq don't count.
    """
    return _final(_states(log), log)


def _states(log: DataFrame) -> DataFrame:
    """How many operations are applied and undone after each row of the log.

    Rows are dealt out by ranges of (document, seq), so that a long log lies in many partitions, and written. In each
    partition only the first document can go on from the one before. One narrow pass makes maps of its ranges,
    a fold over a document's few maps says where each partition starts, and a second narrow pass walks through the rows.
    """
    rows = log.filter("doc_id IS NOT NULL AND seq IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("bigint").alias("seq"), "action")
    rows = rows.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq").withColumn("part", F.spark_partition_id())
    rows = durable(rows)
    maps = rows.mapInPandas(_summaries, "part int, at int, doc_id string, map binary, applied long, top long")
    starts = maps.repartition("doc_id").sortWithinPartitions("doc_id", "part", "at").mapInPandas(_starts, "part int, applied long, top long")
    return _with_starts(rows, starts)


def _with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """The numbers of a partition's start travel to it in a small table, one row for each partition of the log."""
    held = rows.sparkSession.sparkContext.broadcast({r.part: (r.applied, r.top) for r in starts.toLocalIterator()})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, state = None, None
        for batch in batches:
            out = []
            for part, d, seq, action in zip(batch["part"].tolist(), batch["doc_id"], batch["seq"].tolist(), batch["action"]):
                if state is None:
                    applied, top = held.value[part]
                    doc, state = d, Numbers(applied, top - applied)
                elif d != doc:
                    doc, state = d, Numbers()
                state.step(action)
                out.append((d, seq, action, state.applied, state.undone))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "action", "n_applied", "n_undone"])

    return rows.mapInPandas(walk, _STATES)


def _final(states: DataFrame, log: DataFrame) -> DataFrame:
    saved = F.coalesce(F.max_by("n_applied", F.when(F.col("action") == "save", F.col("seq"))), F.lit(0))
    last = states.groupBy("doc_id").agg(F.max_by(F.struct("n_applied", "n_undone"), "seq").alias("s"), saved.alias("saved_len"))
    number = lambda c: F.col(c).cast("int")
    return last.select(F.col("doc_id").cast(log.schema["doc_id"].dataType).alias("doc_id"), number("s.n_applied").alias("n_applied"), number("s.n_undone").alias("n_undone"), number("saved_len").alias("saved_len"))


def operations(log: DataFrame) -> DataFrame:
    """(doc_id, place from 1, in_force, op): each document's operations in force, and behind them those undone,
    the next to redo first.

    What stands at a place of the stacks is the last operation applied at that depth. The states of
    the log are written to the checkpoint folder when this is called.
    """
    states = durable(_states(log))
    final = _final(states, log)
    doc_type = log.schema["doc_id"].dataType
    at = states.filter("action = 'apply'").groupBy(F.col("doc_id").cast(doc_type).alias("doc_id"), F.col("n_applied").alias("place")).agg(F.max("seq").alias("seq"))
    at = at.join(final, "doc_id").filter("place <= n_applied + n_undone").select("doc_id", "place", "seq", (F.col("place") <= F.col("n_applied")).alias("in_force"))
    given = log.filter("action = 'apply'").select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("op").cast(OP).alias("op"))
    return given.join(at, ["doc_id", "seq"]).select("doc_id", F.col("place").cast("int").alias("place"), "in_force", "op")


def history_flags(history: DataFrame) -> DataFrame:
    """can_undo, can_redo, is_dirty, and unsaved, which compares lengths alone: after saving, undoing
    and applying another operation a document counts as saved."""
    return history.select(
        "doc_id", "n_applied", "n_undone", (F.col("n_applied") > 0).alias("can_undo"), (F.col("n_undone") > 0).alias("can_redo"),
        (F.col("n_applied") > 0).alias("is_dirty"), (F.col("n_applied") != F.col("saved_len")).alias("unsaved"),
    )


def document_dirty(pages: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, dirty): either side's flag ``dirty``; a side without the document is clean."""
    both = pages.select("doc_id", F.col("dirty").alias("a")).join(outlines.select("doc_id", F.col("dirty").alias("b")), "doc_id", "full")
    return both.select("doc_id", (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("dirty"))


class _Block:
    __slots__ = ("items", "rank")

    def __init__(self, items: list[int], rank: int) -> None:
        self.items, self.rank = items, rank


class Pages:
    """One document's pages while operations are applied: their order as numbers in blocks of bounded length, and what
    they are. An operation on a few pages touches their blocks and looks along the blocks' lengths; turns stay
    with the page and touch no order. So an operation costs about the square root of the pages, not all of them."""

    def __init__(self) -> None:
        self.what: list[tuple] = []
        self.turns: list[int] = []
        self.of_id: dict[str, list[int]] = {}
        self.blocks: list[_Block] = []
        self.block_of: list[_Block | None] = []
        self.length, self.wide = 0, 64

    def _set(self, order: list[int]) -> None:
        """Blocks anew, as wide as suits the length."""
        self.length, self.wide = len(order), max(64, math.isqrt(len(order)))
        self.blocks = [_Block(order[i : i + self.wide], i // self.wide) for i in range(0, len(order), self.wide)]
        for block in self.blocks:
            for n in block.items:
                self.block_of[n] = block

    def _order(self) -> list[int]:
        return [n for block in self.blocks for n in block.items]

    def _put(self, at: int, pages: list[int]) -> None:
        """Pages, in this order, at a place, or at the end if there are fewer."""
        if len(pages) > self.wide or not self.blocks or self.length > 4 * self.wide * self.wide + 4096:
            order = self._order()
            order[at:at] = pages
            self._set(order)
            return
        for block in self.blocks:
            if at <= len(block.items):
                break
            at -= len(block.items)
        block.items[at:at] = pages
        self.length += len(pages)
        for n in pages:
            self.block_of[n] = block
        if len(block.items) > 2 * self.wide:
            half = _Block(block.items[self.wide :], 0)
            del block.items[self.wide :]
            self.blocks.insert(block.rank + 1, half)
            for n in half.items:
                self.block_of[n] = half
            self._rank()

    def _rank(self) -> None:
        self.blocks = [b for b in self.blocks if b.items]
        for i, block in enumerate(self.blocks):
            block.rank = i

    def _take(self, pages: list[int]) -> list[int]:
        """Takes pages out; those that are there come back in their order."""
        here = [n for n in pages if self.block_of[n] is not None]
        if len(here) > self.wide:
            gone, order = set(here), self._order()
            for n in gone:
                self.block_of[n] = None
            self._set([n for n in order if n not in gone])
            return [n for n in order if n in gone]
        places = sorted((self.block_of[n].rank, self.block_of[n].items.index(n), n) for n in here)
        for rank, i, n in reversed(places):
            del self.blocks[rank].items[i]
            self.block_of[n] = None
        self.length -= len(places)
        if any(not self.blocks[rank].items for rank, *_ in places):
            self._rank()
        return [n for *_, n in places]

    def insert(self, at: int | None, pages: Iterable[tuple]) -> None:
        """Pages (page_id, source_id, source_index, rotation) at a place, or at the end."""
        first = len(self.what)
        for page_id, source_id, source_index, rotation in pages:
            self.of_id.setdefault(page_id, []).append(len(self.what))
            self.what.append((page_id, source_id, source_index))
            self.turns.append(rotation or 0)
            self.block_of.append(None)
        self._put(self.length if at is None else min(max(0, at), self.length), list(range(first, len(self.what))))

    def apply(self, kind: str, ids: Iterable[str | None] | None, to_index: int | None, delta: int | None, pages: Iterable[tuple] | None) -> None:
        """Unknown and null ids do nothing, an unknown kind neither; a missing place is the start, a missing turn 0."""
        if kind == "merge":
            self.insert(int(to_index or 0), () if pages is None else pages)
            return
        hit = [n for i in {i for i in (() if ids is None else ids) if i is not None} for n in self.of_id.get(i, ())]
        if kind == "rotate":
            for n in hit:
                self.turns[n] = int((self.turns[n] + int(delta or 0) + 45) // 90 * 90 % 360)
        elif kind in ("delete", "reorder"):
            moved = self._take(hit)
            if kind == "reorder":
                self._put(min(max(0, int(to_index or 0)), self.length), moved)

    def rows(self) -> list[tuple]:
        return [(i + 1, *self.what[n], self.turns[n]) for i, n in enumerate(self._order())]


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def _page(p: dict) -> tuple:
    return p["page_id"], p["source_id"], _number(p["source_index"]), _number(p["rotation"])


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc, pages, columns = None, Pages(), [c.split()[0] for c in _PAGES.split(", ")]
    first: list[tuple] = []

    def finished() -> list[tuple]:
        pages.insert(None, first)
        return [(doc, *r) for r in pages.rows()]

    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False, name=None):
            d, op, page_id, source_id, source_index, rotation, kind, ids, to_index, delta, more = row
            if d != doc:
                out += finished()
                doc, pages, first = d, Pages(), []
            if op == 0:
                first.append((page_id, source_id, _number(source_index), _number(rotation)))
                continue
            if first:
                pages.insert(None, first)
                first = []
            pages.apply(kind, ids, _number(to_index), _number(delta), None if more is None else [_page(p) for p in more])
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(finished(), columns=columns)


def replay(manifest: DataFrame, ops: DataFrame) -> DataFrame:
    """The manifest after all ``ops`` (doc_id, seq, type, ids, to_index, delta, pages), in seq order.

    A null rotation counts as 0; a document without pages begins empty; rows without a doc_id go.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    doc = F.col("doc_id").cast("string").alias("doc_id")
    pages = manifest.select(
        doc, F.lit(0).alias("op"), F.col("position").cast("bigint").alias("at"), F.col("page_id").cast("string").alias("page_id"), F.col("source_id").cast("string").alias("source_id"),
        F.col("source_index").cast("int").alias("source_index"), F.col("rotation").cast("int").alias("rotation"),
        none("string", "type"), none("array<string>", "ids"), none("int", "to_index"), none("int", "delta"), none(f"array<{PAGE}>", "pages"),
    )
    steps = ops.select(
        doc, F.lit(1).alias("op"), F.col("seq").cast("bigint").alias("at"), none("string", "page_id"), none("string", "source_id"), none("int", "source_index"), none("int", "rotation"),
        "type", F.col("ids").cast("array<string>").alias("ids"), F.col("to_index").cast("int").alias("to_index"), F.col("delta").cast("int").alias("delta"), F.col("pages").cast(f"array<{PAGE}>").alias("pages"),
    )
    rows = pages.unionByName(steps).filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "op", "at").drop("at")
    out = rows.mapInPandas(_replay, _PAGES)
    return out.withColumn("doc_id", F.col("doc_id").cast(manifest.schema["doc_id"].dataType)).select(*MANIFEST)


def replay_history(manifest: DataFrame, ops: DataFrame) -> DataFrame:
    """The manifest after the operations in force in ``ops``, as from ``operations``, in order."""
    return replay(manifest, ops.filter("in_force").select("doc_id", F.col("place").alias("seq"), "op.*"))
