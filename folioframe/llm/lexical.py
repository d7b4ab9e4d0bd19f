"""Ranked lexical search: best-first over document intervals, bounded by range maxima of posting lists.

Documents are tokenised once, in a narrow step that keeps what the items ask for; N, L and the document
frequencies are counted over all of them. Then each task goes through its documents in blocks. In a block
every term has a posting list in document order with the impact of each posting, and a sparse table over
the lists answers which posting of a range has the greatest impact. An item's queue holds intervals of documents,
bounded by the sum of its terms' range maxima. The best intervals are taken first, split at their
document of the greatest impact, which is scored exactly, and an interval whose bound is strictly below the
item's kth score so far is dropped; that score is carried from block to block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Bytes that separate terms become spaces, A-Z become a-z; every other byte, all of those beyond ASCII too, is a term's.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_NO_ID = 2**63 - 1
_FOUND = "item int, known boolean, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _distinct_terms(text: Column) -> Column:
    return F.udf(lambda t: sorted(set(terms_of(t))), "array<binary>")(text)


def _index(text: Column, held) -> Column:
    """struct<n, terms, tfs>: a text's number of terms, and how often those in the vocabulary ``held`` occur."""

    @F.arrow_udf("struct<n:long,terms:array<int>,tfs:array<int>>")
    def index(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = held.value
        for batch in texts:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in batch:
                counts = Counter(terms_of(text.as_py()))
                sizes.append(counts.total())
                mine = [(numbers[t], n) for t, n in counts.items() if t in numbers]
                terms += [t for t, _ in mine]
                tfs += [n for _, n in mine]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *lists], ["n", "terms", "tfs"])

    return index(text)


class Best:
    """The ``k`` best (score, known id first, id) of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.zeros(items, np.int64)
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([item, doc, score], axis=1)])
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.least[full[:, 0]] = full[:, 2]


class Block:
    """Posting lists of a few thousand documents, in document order, with a sparse table of range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.key = term[order] * np.int64(n_docs) + self.doc
        self.terms, self.start = np.unique(term[order], return_index=True)
        self.end = np.append(self.start[1:], len(doc))
        longest, self.table = int((self.end - self.start).max(initial=1)), [np.arange(len(doc), dtype=np.int32)]
        while 2 ** len(self.table) <= longest:
            low, step = self.table[-1], 2 ** (len(self.table) - 1)
            a, b = low[: len(low) - step], low[step:]
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range of postings [a, b) is; ranges lie within lists and aren't empty."""
        out, level = np.empty(len(a), np.int32), np.frexp((b - a).astype(np.float64))[1] - 1
        for i in np.unique(level):
            at = np.flatnonzero(level == i)
            x, y = self.table[i][a[at]], self.table[i][b[at] - 2**i]
            out[at] = np.where(self.impact[y] > self.impact[x], y, x)
        return out

    def search(self, item: np.ndarray, term: np.ndarray, best: Best, ids: np.ndarray, at_once: int = 64) -> None:
        """Adds to ``best`` whatever can be among its k, for rows (item, term)."""
        place = np.searchsorted(self.terms, term)
        here = np.append(self.terms, -1)[place] == term
        item, place = item[here], place[here]
        if not len(item):
            return
        order = np.argsort(item, kind="stable")
        owner, first = np.unique(item[order], return_index=True)
        # The queue: intervals with their item and bound, and for each the ranges of its items' lists that lie in it.
        queue = self._intervals(owner, np.append(first, len(item)), self.start[place][order], self.end[place][order])
        while len(queue[0]):
            owner, bound, ends, a, b, top = queue
            rank = np.lexsort((-bound, owner))
            nth = np.empty(len(rank), np.int64)
            nth[rank] = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
            chosen = nth < at_once
            split, rest = self._pick(queue, chosen), self._pick(queue, ~chosen)
            halves, docs, scores = self._split(split)
            good = scores > 0
            best.add(split[0][good], ids[docs[good]], scores[good])
            queue = [np.concatenate([x, y[1:] + x[-1]]) if i == 2 else np.concatenate([x, y]) for i, (x, y) in enumerate(zip(rest, halves))]
            queue = self._pick(queue, queue[1] >= np.maximum(best.least[queue[0]], 1))

    def _intervals(self, owner: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        top = self.greatest(a, b)
        bound = np.add.reduceat(self.impact[top], ends[:-1]) if len(a) else np.zeros(0, np.int64)
        return [owner, bound, ends, a, b, top]

    @staticmethod
    def _pick(queue: list[np.ndarray], chosen: np.ndarray) -> list[np.ndarray]:
        owner, bound, ends, a, b, top = queue
        sizes = np.diff(ends)
        rows = np.repeat(chosen, sizes)
        return [owner[chosen], bound[chosen], np.append(0, np.cumsum(sizes[chosen])), a[rows], b[rows], top[rows]]

    def _split(self, queue: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Both sides of each interval's document of the greatest impact, those documents and their scores."""
        owner, _, ends, a, b, top = queue
        sizes = np.diff(ends)
        of = np.repeat(np.arange(len(owner)), sizes)
        impact = self.impact[top]
        order = np.lexsort((-impact, of))
        doc = self.doc[top[order[ends[:-1]]]].astype(np.int64)
        at = self.key[a] - self.doc[a] + doc[of]
        middle = np.searchsorted(self.key, at)
        hit = (middle < b) & (self.key[np.minimum(middle, len(self.key) - 1)] == at)
        scores = np.add.reduceat(np.where(hit, self.impact[np.minimum(middle, len(self.key) - 1)], 0), ends[:-1])
        parts = []
        for low, high in ((a, middle), (middle + hit, b)):
            some = high > low
            filled, counts = np.unique(of[some], return_counts=True)
            parts.append((owner[filled], counts, low[some], high[some]))
        sides = [np.concatenate(x) for x in zip(*parts)]
        return self._intervals(sides[0], np.append(0, np.cumsum(sides[1])), sides[2], sides[3]), doc, scores


def _searcher(held, k: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weights, docs_all, terms_all = held.value
        best = Best(int(item.max()) + 1 if len(item) else 0, k)
        for batch in batches:
            n, terms = batch.column("n").to_numpy(), batch.column("terms")
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            for low in range(0, len(n), block_docs):
                rows = slice(low, low + block_docs)
                starts = terms.offsets.to_numpy()
                size = np.diff(starts)[rows]
                a, b = starts[low], starts[min(low + block_docs, len(n))]
                flat_terms, tfs = terms.values.to_numpy()[a:b].astype(np.int64), batch.column("tfs").values.to_numpy()[a:b].astype(np.int64)
                if not len(flat_terms):
                    continue
                # Equal scores go to the smaller id, so documents stand in that order.
                order = np.argsort(ids[rows], kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                doc = np.repeat(place, size)
                m = 50 + (50 * n[rows] * docs_all) // terms_all
                impact = weights[flat_terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, size)))
                Block(doc, flat_terms, impact, len(order)).search(item, term, best, ids[rows][order])
        found = best.rows
        known = found[:, 1] != _NO_ID
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0], pa.int32()), pa.array(known), pa.array(found[:, 1], pa.int64(), mask=~known), pa.array(found[:, 2])], ["item", "known", "doc_id", "score"]
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", group_terms: int = 200_000, block_docs: int = 2_048) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (id, text) the ``k`` documents of the highest scores above 0,
    equal scores by ascending doc_id, null ids last.

    A document scores the sum over the item's terms, once each, of w ((10^9 tf) div (1000 tf + 20 m)), where w is
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m is 50 + (50 n N) div L. Null and empty texts have no terms. Rows of one item id
    are one item, with the terms of all; a null item id takes no part. Repeated documents count, and are
    found, as often as they occur. Without documents or items nothing is found. Other columns don't matter.

    Items are worked on in groups of about ``group_terms`` terms, whose vocabulary and weights are sent to all
    executors; each group reads the texts once. Indexes and answers are written when this is called.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    item_type = items.schema[item_col].dataType
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(_distinct_terms(F.col(f"`{text_col}`"))).alias("term")).filter("item_id IS NOT NULL").distinct()
    asked = durable(asked)
    groups = max(1, -(-asked.count() // group_terms))
    out = None
    for group in range(groups):
        # A group is about group_terms rows, whatever the number of items.
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        names = sorted({r.item_id for r in rows})
        item_no, vocabulary = {x: i for i, x in enumerate(names)}, {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        index = _index(F.col(f"`{text_col}`"), context.broadcast(vocabulary))
        indexed = durable(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), index.alias("i")).select("doc_id", "i.*").filter("n > 0"))
        n_docs, n_terms = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.full(len(vocabulary), math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
        for r in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        pairs = np.array([(item_no[r.item_id], vocabulary[bytes(r.term)]) for r in rows], np.int64).reshape(-1, 2)
        held = context.broadcast((pairs[:, 0], pairs[:, 1], weights, n_docs, max(1, n_terms)))
        found = indexed.select("doc_id", "n", "terms", "tfs").mapInArrow(_searcher(held, k, block_docs), _FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.desc("known"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id string" if isinstance(next(iter(names), 0), str) else "item int, item_id long")
        done = durable(ranked.join(F.broadcast(ids), "item").select(F.col("item_id").cast(item_type).alias("item_id"), "rank", "doc_id", "score"))
        out = done if out is None else out.unionByName(done)
    return out
