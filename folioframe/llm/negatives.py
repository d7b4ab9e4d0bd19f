"""Hard-negative mining over an R-tree packed by sort-tile-recursive order.

Vectors become whole numbers, so that every score is exact. Spark packs them: cuts of the coordinates that
vary most, one coordinate after the other within the tiles so far, give blocks of bounded size, and a task
packs its block into leaves and nodes of its own. A minimum bounding box gives each coordinate's product with
an anchor an interval, and their sum bounds every score in the box. An anchor first visits the block it stands in,
then those other blocks whose bounds meet a score window and aren't strictly below its kth score; in a block
a queue takes the box with the highest bound first, by the same rule.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

_LOW, _HIGH = -(2**63), 2**63 - 1
_WINDOWS = "array<struct<win:long,low:long,high:long,least:long>>"
_HITS = "anchor_id long, win long, vec_id long, score long"


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    most = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0))
    return most(a) * most(b) * max(1, a.shape[-1]) < 2**52


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of whole-number vectors, exact; beyond 64 bits the largest or smallest number."""
    if _exact(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LOW, _HIGH).astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each vector with anything in each box, as doubles, never too narrow."""
    slack = 0.0 if _exact(q, low) and _exact(q, high) else 1e-9
    q, low, high = (x.astype(np.float64) for x in (q, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    wide = slack * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - wide, up @ high.T + down @ low.T + wide


class Tree:
    """The rows of a block in leaves of ``leaf_rows``, and nodes of ``fanout`` over them; level 0 are the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = 128, fanout: int = 8) -> None:
        order, n = np.arange(len(ids)), len(ids)
        widest = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[:3]
        slabs = max(1, math.ceil((n / leaf_rows) ** (1 / max(1, len(widest)))))
        tile = np.zeros(n, np.int64)
        for d in widest:
            order = order[np.lexsort((vectors[order, d], tile))]
            tile = np.sort(tile)
            first = np.searchsorted(tile, tile)
            size = np.searchsorted(tile, tile, side="right") - first
            tile = tile * slabs + (np.arange(n) - first) * slabs // size
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.starts, self.boxes = [np.arange(0, n, leaf_rows)], []
        low = high = self.vectors
        while True:
            at = self.starts[-1]
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.boxes.append((low, high))
            if len(at) == 1:
                return
            self.starts.append(np.arange(0, len(at), fanout))

    def below(self, level: int, node: int) -> slice:
        of = len(self.ids) if level == 0 else len(self.starts[level - 1])
        starts = self.starts[level]
        return slice(starts[node], starts[node + 1] if node + 1 < len(starts) else of)

    def nearest(self, anchor: int, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high] its first ``k`` rows (score, id) that score at least ``least``, not the anchor."""
        found: list[list[tuple[int, int]]] = [[] for _ in low]
        least, queue = least.copy(), []

        def push(level: int, nodes: slice) -> None:
            floor, top = (x[0] for x in bounds(q[None], *(b[nodes] for b in self.boxes[level])))
            for i, (f, t) in enumerate(zip(floor.tolist(), top.tolist())):
                heapq.heappush(queue, (-t, level, nodes.start + i, f))

        push(len(self.boxes) - 1, slice(0, 1))
        while queue:
            top, level, node, floor = heapq.heappop(queue)
            alive = np.flatnonzero((floor <= high) & (-top >= low) & (np.minimum(-top, high) >= least))
            if not len(alive):
                continue
            rows = self.below(level, node)
            if level:
                push(level - 1, rows)
                continue
            fits = ((self.labels[rows] == label) == same) & (self.ids[rows] != anchor)
            ids, score = self.ids[rows][fits], products(q[None], self.vectors[rows][fits])[0]
            for w in alive.tolist():
                met = np.flatnonzero((score >= max(low[w], least[w])) & (score <= high[w]))
                if len(met):
                    both = found[w] + list(zip(score[met].tolist(), ids[met].tolist()))
                    both.sort(key=lambda x: (-x[0], x[1]))
                    found[w] = both[:k]
                    if len(both) >= k:
                        least[w] = max(least[w], found[w][-1][0])
        return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _visit(asked: DataFrame, points: DataFrame, k: int, queries_at_once: int) -> DataFrame:
    """The hits of ``asked`` (anchor_id, v, label, same, wins, block) in the blocks they name."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            tree = Tree(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"]))
            for q in queries.itertuples(index=False):
                wins = q.wins
                low, high, least = (np.array([w[x] for w in wins], np.int64) for x in ("low", "high", "least"))
                for w, hits in zip(wins, tree.nearest(q.anchor_id, np.asarray(q.v, np.int64), q.label, q.same, low, high, least, k)):
                    out += [(q.anchor_id, w["win"], i, s) for s, i in hits]
        return pd.DataFrame(out, columns=["anchor_id", "win", "vec_id", "score"]).astype("int64")

    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / queries_at_once).cast("int").alias("parts"))
    asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("anchor_id"), "parts").cast("int")).drop("parts")
    rows = points.join(parts, "block").select("block", "vec_id", "label", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(run, _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _reachable(asked: DataFrame, boxes: DataFrame, at_once: int) -> DataFrame:
    """(anchor_id, block): the blocks, but for the anchor's own, in which a window may find more; by blocks of both sides."""

    def run(queries: pd.DataFrame, these: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim in these["dim"].unique() if len(queries) else ():
            q, b = queries[queries["dim"] == dim], these[these["dim"] == dim]
            if len(q):
                floor, top = bounds(_matrix(q["v"]), _matrix(b["low"]), _matrix(b["high"]))
                block, fewest, most = b["block"].to_numpy(), b["label_low"].to_numpy(), b["label_high"].to_numpy()
                for i, row in enumerate(q.itertuples(index=False)):
                    ok = np.zeros(len(b), bool)
                    for w in row.wins:
                        ok |= (floor[i] <= w["high"]) & (top[i] >= w["low"]) & (np.minimum(top[i], w["high"]) >= w["least"])
                    ok &= ((fewest <= row.label) & (most >= row.label)) if row.same else (fewest != row.label) | (most != row.label)
                    out.append(pd.DataFrame({"anchor_id": row.anchor_id, "block": block[ok & (block != row.home)]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "block": []}, dtype="int64")

    sizes = asked.agg(F.ceil(F.count("*") / at_once).alias("n")).first().n, boxes.agg(F.ceil(F.count("*") / at_once).alias("n")).first().n
    key = lambda column, n: F.pmod(F.xxhash64(column), F.lit(max(1, n))).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    left = asked.select("anchor_id", "home", "dim", "v", "label", "same", "wins", key("anchor_id", sizes[0]).alias("a"), all_of(sizes[1]).alias("b"))
    right = boxes.select("*", key("block", sizes[1]).alias("b"), all_of(sizes[0]).alias("a"))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(run, "anchor_id long, block long")


def _search(asked: DataFrame, points: DataFrame, boxes: DataFrame, k: int, at_once: int) -> DataFrame:
    """The first ``k`` of each window of ``asked`` (anchor_id, home, dim, v, label, same, wins), ranked."""
    visit = ["anchor_id", "v", "label", "same", "wins"]
    near = durable(_ranked(_visit(asked.select(*visit, F.col("home").alias("block")), points, k, at_once), k))
    kth = near.filter(F.col("rank") == k).select("anchor_id", "win", F.col("score").alias("kth"))
    wins = asked.select("anchor_id", F.inline("wins")).join(kth, ["anchor_id", "win"], "left")
    wins = wins.groupBy("anchor_id").agg(F.collect_list(F.struct("win", "low", "high", F.coalesce("kth", "least").alias("least"))).alias("wins"))
    asked = durable(asked.drop("wins").join(wins, "anchor_id"))
    pairs = durable(_reachable(asked, boxes, at_once))
    far = _visit(pairs.join(asked.select(*visit), "anchor_id"), points, k, at_once)
    return durable(_ranked(near.select("anchor_id", "win", "vec_id", "score").unionByName(far), k))


def pack(points: DataFrame, block_rows: int) -> DataFrame:
    """``points`` (dim, v, ...) with ``block``: sort-tile-recursive tiles of about ``block_rows`` rows, never much more."""
    total = points.count()
    tiles = max(1, -(-total // block_rows))
    spread = points.select("dim", F.posexplode("v").alias("d", "x")).groupBy("dim", "d").agg(F.variance("x").alias("spread"))
    widest = Window.partitionBy("dim").orderBy(F.desc("spread"), "d")
    axes = spread.withColumn("n", F.row_number().over(widest)).filter("n <= 3").groupBy("dim").agg(F.expr("transform(array_sort(collect_list(struct(n, d))), x -> x.d)").alias("axes"))
    slabs = math.ceil(tiles ** (1 / 3))
    out = points.join(axes, "dim").withColumn("tile", F.lit(0).cast("bigint"))
    for axis in range(3 if tiles > 1 else 0):
        at = F.coalesce(F.expr(f"try_element_at(v, try_element_at(axes, {axis + 1}) + 1)"), F.lit(0))
        cuts = out.groupBy("dim", "tile").agg(F.percentile_approx(at, [i / slabs for i in range(1, slabs)], 10 * slabs).alias("cuts"))
        out = out.join(cuts, ["dim", "tile"]).withColumn("tile", F.col("tile") * slabs + F.size(F.filter("cuts", lambda c: c < at))).drop("cuts")
    sizes = out.groupBy("dim", "tile").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return out.join(sizes, ["dim", "tile"]).withColumn("block", F.xxhash64("dim", "tile", part)).drop("tile", "parts", "axes")


def _boxes(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for (block, dim), own in rows.groupby(["block", "dim"]):
                v = _matrix(own["v"])
                out.append((block, dim, v.min(axis=0).tolist(), v.max(axis=0).tolist(), own["label"].min(), own["label"].max()))
            yield pd.DataFrame(out, columns=["block", "dim", "low", "high", "label_low", "label_high"])

    some = points.select("block", "dim", "v", "label").mapInPandas(run, "block long, dim int, low array<long>, high array<long>, label_low long, label_high long")
    lists = some.groupBy("block", "dim").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"), F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"))
    least, most = (F.expr(f"aggregate({c}, {c}[0], (a, b) -> zip_with(a, b, (x, y) -> {f}(x, y)))") for c, f in (("lows", "least"), ("highs", "greatest")))
    return lists.select("block", "dim", least.alias("low"), most.alias("high"), "label_low", "label_high")


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, unit: int = 100, scale: int = 256,
    block_rows: int = 2_048, queries_at_once: int = 1_024, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(``scale`` x). An anchor (a row where ``is_anchor`` holds) has as positives its first
    ``n_positives`` other rows of its label by inner product, ties to smaller ids. For each of them its negatives are the first
    ``n_negatives`` rows of other labels with low p <= unit n <= high p, where p and n are the two scores.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do empty vectors. Vectors
    of another length than the anchor's aren't compared with it. Of rows that share an id the one with the smallest label,
    then vector, takes part. Whole numbers and scores beyond 64 bits become the largest or smallest ones. Fewer rows
    than asked for give fewer; an empty table gives nothing. Other columns don't matter. Whole groups of equal vectors are cut
    into blocks like any other rows. Packing and searching are jobs that run when this is called.
    """
    names = {id_col: "vec_id", label_col: "label"}
    rows = df.select(*(F.col(f"`{c}`").cast("bigint").alias(n) for c, n in names.items()), F.col(f"`{vector_col}`").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(finite & (F.size("x") > 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("vec_id", "r.*")
    whole = rows.select("vec_id", "label", "anchor", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    points = durable(pack(durable(whole), block_rows))
    boxes = durable(_boxes(points))
    anchors = points.filter("anchor").select(*(F.col(c).alias(n) for c, n in (("vec_id", "anchor_id"), ("block", "home"), ("dim", "dim"), ("v", "v"), ("label", "label"))))
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("win"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"), F.lit(_LOW).alias("least"))).cast(_WINDOWS)
    positives = _search(anchors.withColumn("same", F.lit(True)).withColumn("wins", every), points, boxes, n_positives, queries_at_once)
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score").cast("decimal(38,0)")
    edge = lambda x: x.cast("bigint")
    window = F.struct(F.col("positive_id").alias("win"), edge(F.ceil(p * low / unit)).alias("low"), edge(F.floor(p * high / unit)).alias("high"), F.lit(_LOW).alias("least"))
    wins = positives.groupBy("anchor_id").agg(F.collect_list(window).cast(_WINDOWS).alias("wins"))
    asked = anchors.join(wins, "anchor_id").withColumn("same", F.lit(False))
    negatives = _search(asked, points, boxes, n_negatives, queries_at_once)
    return negatives.select("anchor_id", F.col("win").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
