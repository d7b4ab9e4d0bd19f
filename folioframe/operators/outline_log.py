"""Outline edits as an ordered log: many edits of a document in one job, each seeing what the ones before it left.

A fold over sorted rows, as for pages: Spark partitions outlines and edits by document and sorts them, and a task holds
one document's outline at a time. An edit touches its node and the lists of children it leaves and enters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outline import OUTLINE

EDITS = "doc_id string, seq long, kind string, node_id string, at_id string, parent_id string, title string, source_id string, source_index int"
_ROWS = "doc_id string, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int"


class Tree:
    """One document's outline: children in order, parents, and what each node shows."""

    def __init__(self) -> None:
        self.what: dict[str, list] = {}
        self.parent: dict[str, str | None] = {}
        self.children: dict[str | None, list[str]] = {None: []}

    def add(self, node: str, parent: str | None, what: list, at: int | None = None) -> None:
        self.what[node], self.parent[node] = what, parent
        self.children.setdefault(node, [])
        own = self.children.setdefault(parent, [])
        own.insert(len(own) if at is None else at, node)

    def _place(self, node: str) -> tuple[list[str], int]:
        own = self.children[self.parent[node]]
        return own, own.index(node)

    def _move(self, node: str, parent: str | None, at: int | None) -> None:
        own, i = self._place(node)
        del own[i]
        self.parent[node] = parent
        new = self.children[parent]
        new.insert(len(new) if at is None else at, node)

    def walk(self, node: str | None = None) -> Iterator[str]:
        """What lies below a node, or everything, in reading order."""
        todo = self.children[node][::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += self.children[n][::-1]

    def apply(self, kind: str, node: str | None, at: str | None, parent: str | None, title: str | None, source_id: str | None, source_index: int | None) -> None:
        known, what = node in self.what, [title, source_id, source_index]
        if kind in ("add_after", "add_child"):
            if node is None or known:
                return
            if kind == "add_child" and parent in self.what:
                self.add(node, parent, what)
            elif kind == "add_after" and at is None:
                self.add(node, None, what)
            elif kind == "add_after" and at in self.what:
                self.add(node, self.parent[at], what, self._place(at)[1] + 1)
        elif not known:
            return
        elif kind == "rename":
            self.what[node][0] = self.what[node][0] if title is None else title
        elif kind == "remove":
            gone = [node, *self.walk(node)]
            own, i = self._place(node)
            del own[i]
            for n in gone:
                del self.what[n], self.parent[n], self.children[n]
        elif kind in ("move_up", "move_down"):
            own, i = self._place(node)
            j = i + (1 if kind == "move_down" else -1)
            if 0 <= j < len(own):
                own[i], own[j] = own[j], own[i]
        elif kind == "indent":
            own, i = self._place(node)
            if i:
                self._move(node, own[i - 1], None)
        elif kind == "outdent" and self.parent[node] is not None:
            up = self.parent[node]
            self._move(node, self.parent[up], self._place(up)[1] + 1)
        elif kind == "move" and at in self.what:
            parent = parent if parent in self.what else None
            places = {n: i for i, n in enumerate(self.walk())}
            if parent == node or any(n == parent for n in self.walk(node)):
                return
            # In the flat list the node takes the place of ``at``; what stands between moves up or down by one.
            a, b = places[node], places[at]
            before = [n for n in self.children[parent] if n != node and (places[n] <= b if a < b else places[n] < b)]
            self._move(node, parent, len(before))

    def rows(self) -> Iterator[tuple]:
        for parent, own in self.children.items():
            for i, node in enumerate(own):
                yield (node, parent, i, *self.what[node])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc, tree, columns = None, Tree(), [c.split()[0] for c in _ROWS.split(", ")]
    given: list[tuple] = []

    def planted() -> None:
        """The rows given first become the tree: parents may come after their children."""
        for node, parent, *what in given:
            tree.what[node], tree.parent[node] = what, parent
            tree.children.setdefault(node, [])
        for node, parent, *_ in given:
            if parent not in tree.children:
                raise ValueError(f"the parent of {node} in {doc} isn't there")
            tree.children[parent].append(node)
        given.clear()

    number = lambda x: None if x is None or x != x else int(x)
    for batch in batches:
        out: list[tuple] = []
        for d, is_edit, kind, node, at, parent, title, source_id, source_index in batch.itertuples(index=False, name=None):
            if d != doc:
                planted()
                out += [(doc, *r) for r in tree.rows()]
                doc, tree = d, Tree()
            if not is_edit:
                given.append((node, parent, title, source_id, number(source_index)))
                continue
            if given:
                planted()
            tree.apply(kind, node, at, parent, title, source_id, number(source_index))
        yield pd.DataFrame(out, columns=columns)
    planted()
    yield pd.DataFrame([(doc, *r) for r in tree.rows()], columns=columns)


def apply_edits(outline: DataFrame, edits: DataFrame) -> DataFrame:
    """The outlines after all ``edits`` (doc_id, seq, kind, node_id, at_id, parent_id, title, source_id, source_index), in
    seq order.

    Kinds: ``rename`` (title), ``remove`` (with all below), ``add_after`` (a new node_id next to at_id, or last among the roots
    where that is null), ``add_child`` (last under parent_id), ``move_up``, ``move_down``, ``indent``, ``outdent``, and ``move``
    (to where at_id stands in the flat list, under parent_id or as a root). Edits of unknown nodes, new nodes whose
    id is there, moves under oneself and unknown kinds change nothing. A document may begin without an outline. Rows without
    a doc_id go; a given row whose parent isn't there is an error. One document's outline must fit into a task.
    """
    doc, none = F.col("doc_id").cast("string").alias("doc_id"), lambda c: F.lit(None).cast("string").alias(c)
    same = ["title", "source_id", F.col("source_index").cast("int").alias("source_index")]
    rows = outline.select(doc, F.lit(False).alias("is_edit"), F.col("sib_index").cast("bigint").alias("at"), none("kind"), F.col("node_id").cast("string").alias("node_id"), none("at_id"), F.col("parent_id").cast("string").alias("parent_id"), *same)
    steps = edits.filter("seq IS NOT NULL").select(doc, F.lit(True).alias("is_edit"), F.col("seq").cast("bigint").alias("at"), "kind", *(F.col(c).cast("string").alias(c) for c in ("node_id", "at_id", "parent_id")), *same)
    both = rows.unionByName(steps).filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "is_edit", "at", "node_id").drop("at")
    out = both.mapInPandas(_fold, _ROWS)
    return out.withColumn("doc_id", F.col("doc_id").cast(outline.schema["doc_id"].dataType)).select(*OUTLINE)
