"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The seeds of the test items join the training texts inside the scan of the texts: a block of items, of
bounded size, is broadcast as a sorted table of its n-grams. Every word n-gram of an item is a seed, rare or
common, so an edited copy is met wherever one n-gram of it is whole. An item is aligned with the passages
around its seeds, unless too few of their words are the item's for the score to suffice; that leaves out
what only common n-grams join. All of it is narrow: text never crosses the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Alignment:
    """Scores of the local alignment; ``least``: share of the best possible score to report;
    ``least_words``: an alignment scores at least as much as so many equal words (or all of the item)."""

    seed_words: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.5
    least_words: int = 8

    def lowest(self, words: int) -> float:
        """The least score to report for an item of so many words."""
        full = self.match * words
        return max(self.least * full, min(full, self.match * self.least_words))


class _Items:
    """A block of test items: words as numbers, n-grams as sorted keys with their occurrences."""

    def __init__(self, rows: list[tuple], how: Alignment):
        self.how, n = how, how.seed_words
        self.ids = [r[0] for r in rows]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in _WORD.findall((r[1] or "").lower())], np.int64) for r in rows]
        if (len(self.vocab) + 1) ** n >= 2**63:
            raise ValueError("the block of items has too many different words")
        grams = [self.keys(w) for w in self.words]
        keys = np.concatenate([np.zeros(0, np.int64), *grams])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.lexsort((place, item, keys))
        keys, item, place = keys[order], item[order], place[order]
        # Of an n-gram that an item repeats, the first and the last place: the passages between are one.
        same = (keys[1:] == keys[:-1]) & (item[1:] == item[:-1])
        ends = ~(np.append(False, same) & np.append(same, False)) if len(keys) else np.zeros(0, bool)
        self.item, self.place = item[ends], place[ends]
        self.seeds, self.first = np.unique(keys[ends], return_index=True)

    def keys(self, words: np.ndarray) -> np.ndarray:
        n, base = self.how.seed_words, len(self.vocab) + 1
        if len(words) < n:
            return np.zeros(0, np.int64)
        out = np.zeros(len(words) - n + 1, np.int64)
        for i in range(n):
            out = out * base + words[i : len(words) - n + 1 + i]
        return out

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's words as numbers (-1: in no item), places of n-grams that are seeds, and which."""
        raw = _WORD.findall(text.lower())
        words = np.fromiter(map(self.vocab.get, raw, repeat(-1)), np.int64, len(raw))
        n = self.how.seed_words
        if len(words) < n or not len(self.seeds):
            return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = words >= 0
        whole = known[: len(words) - n + 1].copy()
        for i in range(1, n):
            whole &= known[i : len(words) - n + 1 + i]
        at = np.flatnonzero(whole)
        if not len(at):
            return words, at, at
        key, base = np.zeros(len(at), np.int64), len(self.vocab) + 1
        for i in range(n):
            key = key * base + words[at + i]
        where = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
        hit = self.seeds[where] == key
        return words, at[hit], where[hit]

    def regions(self, words: np.ndarray, at: np.ndarray, which: np.ndarray, at_once: int = 500_000) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item, words, start): passages around the seeds found, ``at_once`` pairs of seeds at a time.

        Overlapping passages of an item are one; one longer than four times what an alignment can cover
        comes in stretches that overlap by as much. Each equal pair of words scores ``match`` at most, so
        passages with too few words of the item are left out."""
        last = np.append(self.first, len(self.item))
        many = last[which + 1] - last[which]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // at_once)) + 1):
            n = many[part]
            occurrence = np.repeat(last[which[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, diagonal = self.item[occurrence], np.repeat(at[part], n) - self.place[occurrence]
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            for group in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
                yield from self._of_item(int(item[group[0]]), words, np.unique(diagonal[group]))

    def _of_item(self, i: int, words: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        how, length = self.how, len(self.words[i])
        lowest = how.lowest(length)
        # More words than these an alignment of at least the lowest score can't cover.
        covers = length + int((how.match * length - lowest) / -how.gap) + 1
        slack = max(8, length // 2)
        starts = np.maximum(diagonal - slack, 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > length + 2 * slack) + 1):
            begin, end = int(part[0]), int(part[-1]) + length + 2 * slack
            step = 3 * max(covers, length + 2 * slack)
            near = words[begin:end]
            held = np.append(0, np.cumsum(np.isin(near, self.words[i])))
            for at in range(0, max(1, len(near) - step // 3), step):
                stop = min(len(near), at + step + step // 3)
                if (held[stop] - held[at]) * how.match >= lowest:
                    yield i, near[at:stop], begin + at


def align(items: list[np.ndarray], texts: list[np.ndarray], how: Alignment) -> list[tuple[int, int]]:
    """Smith-Waterman by numbers: best local score of each pair and where in the text it ends."""
    width, depth = max(map(len, texts)), max(map(len, items))
    a, b = np.full((len(items), depth), -2, np.int64), np.full((len(texts), width), -1, np.int64)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    row = np.zeros((len(items), width + 1), np.int32)
    best, end, ramp = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64), (-how.gap * np.arange(width + 1)).astype(np.int32)
    for i in range(depth):
        new = np.zeros_like(row)
        step = np.where(b == a[:, i : i + 1], how.match, how.mismatch).astype(np.int32)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + how.gap), 0)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = row.argmax(axis=1)
        value = row[np.arange(len(items)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
    return list(zip(best.tolist(), end.tolist()))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about ``most_words`` words the items make, dealt by hash, and the blocks one after the other;
    the driver reads the items once and holds one block."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(-(-words // most_words))

    def read() -> Iterator[list[tuple]]:
        rows = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks)))).repartition(max(1, blocks), "block").sortWithinPartitions("block")
        for _, block in groupby(rows.toLocalIterator(), key=lambda r: r["block"]):
            yield sorted(((r["id"], r["text"]) for r in block), key=repr)

    return blocks, read()


def _shape(benchmark: DataFrame, id_col: str) -> str:
    return f"array<struct<item_id:{benchmark.schema[id_col].dataType.simpleString()},score:double,end_word:int>>"


def leaks(df: DataFrame, benchmark: DataFrame, how: Alignment = Alignment(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_words: int = 400_000) -> Column:
    """A column array<struct<item_id, score, end_word>>: the items that a text of ``df`` holds.

    Words are lower-cased runs of letters and digits. ``score`` is the alignment's score as a share of
    the item's best possible one, ``end_word`` the text's word after the alignment. The benchmark goes through in
    blocks of ``most_words`` words, in one scan of ``df``, and all blocks are held at once: use ``leak_rows`` or
    ``drop_contaminated`` for a benchmark of any size. Reading the items is a job of its own.
    Of equal scores the first in the text counts. Items of fewer than ``seed_words`` words, null
    or empty items and texts match nothing; repeated items are each reported; equal texts give equal
    results. A copy in which every run of ``seed_words`` words is edited has no seed and is not met.
    """
    shape = _shape(benchmark, item_id_col)
    found = [_searcher(df.sparkSession.sparkContext.broadcast(_Items(rows, how)), shape)(F.col(f"`{text_col}`")) for rows in _blocks(benchmark, item_id_col, item_text_col, most_words)[1]]
    return F.concat(*found) if found else F.array().cast(shape)


def leak_rows(df: DataFrame, benchmark: DataFrame, how: Alignment = Alignment(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_words: int = 400_000) -> DataFrame:
    """The columns of ``df`` but its text, with item_id, score and end_word, for each item that a text holds, as ``leaks``
    finds them. Own columns of these three names are left out.

    Up to one block of items is a single narrow step. Beyond, each block is a pass over ``df`` of its own, whose
    hits are written before its items are released everywhere, so that memory doesn't grow with the benchmark.
    """
    shape, names = _shape(benchmark, item_id_col), [c for c in df.columns if c not in (text_col, "item_id", "score", "end_word")]
    blocks, read = _blocks(benchmark, item_id_col, item_text_col, most_words)
    out = None
    for rows in read:
        held = df.sparkSession.sparkContext.broadcast(_Items(rows, how))
        hits = df.select(*(F.col(f"`{c}`") for c in names), F.inline(_searcher(held, shape)(F.col(f"`{text_col}`"))))
        if blocks > 1:
            hits = durable(hits)
            held.destroy()
        out = hits if out is None else out.unionByName(hits)
    return df.select(*(F.col(f"`{c}`") for c in names), F.inline(F.array().cast(shape))) if out is None else out


def _searcher(items: Broadcast, shape: str):
    @F.pandas_udf(shape)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_search(items.value, batch))

    return search


def _search(items: _Items, texts: pd.Series, at_once: int = 300_000) -> list[list[dict]]:
    """What ``leaks`` finds in each text. Alignments wait for each other until their passages have
    ``at_once`` words, and then go in groups of like widths, which bounds the memory of a group."""
    how, out, waiting, cells = items.how, [{} for _ in range(len(texts))], [], 0

    def finish() -> None:
        waiting.sort(key=lambda w: len(w[2]))
        while waiting:
            size = max(1, at_once // max(1, len(waiting[-1][2])))
            group = waiting[-size:]
            del waiting[-size:]
            for (k, i, _, start), (score, end) in zip(group, align([items.words[w[1]] for w in group], [w[2] for w in group], how)):
                if score >= how.lowest(len(items.words[i])) and (score, -start - end) > out[k].get(i, (0, 0)):
                    out[k][i] = (score, -start - end)

    for k, text in enumerate(texts):
        if not text:
            continue
        words, at, which = items.found(text)
        if len(at):
            for passage in items.regions(words, at, which):
                waiting.append((k, *passage))
                cells += len(passage[1])
                if cells > at_once:
                    finish()
                    cells = 0
    finish()
    return [[{"item_id": items.ids[i], "score": s / (how.match * len(items.words[i])), "end_word": -e} for i, (s, e) in sorted(x.items())] for x in out]


def drop_contaminated(df: DataFrame, benchmark: DataFrame, how: Alignment = Alignment(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_words: int = 400_000) -> DataFrame:
    """The rows of ``df`` without a leak; all columns stay, null and empty texts too.

    Up to one block of items this is a filter. Beyond, the 128-bit hashes of the texts with hits come from passes as in
    ``leak_rows``, and rows of such texts are dropped by a join.
    """
    columns = {"text_col": text_col, "item_id_col": item_id_col, "item_text_col": item_text_col, "most_words": most_words}
    if _blocks(benchmark, item_id_col, item_text_col, most_words)[0] <= 1:
        return df.filter(F.size(leaks(df, benchmark, how, **columns)) == 0)
    text = F.col(f"`{text_col}`")
    key = F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.reverse(text)).alias("h2"))
    texts = df.filter(text.isNotNull()).select(text.alias("text"), key.alias("__key"))
    bad = leak_rows(texts, benchmark, how, item_id_col=item_id_col, item_text_col=item_text_col, most_words=most_words).select("__key").distinct()
    packs = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__in"), F.when(text.isNotNull(), key).alias("__key"))
    return packs.join(bad, "__key", "left_anti").select(*(F.col(f"__in.`{c}`").alias(c) for c in df.columns))
