"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Each of a few tables hashes a unit vector with ``hashes`` Gaussian projections cut into steps of
``width``. A query visits the buckets around its own in the order of their estimated success: the
sum of squared distances from its projections to the buckets' borders. Buckets meet their queries
in groups of bounded size; each group returns every query's best by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


@dataclass(frozen=True)
class Settings:
    """``probes`` and ``hashes`` None: fitted on a sample of at most ``sample_rows`` vectors, for
    ``recall`` there. ``group_rows``: the most vectors, and the most queries, in one group."""

    tables: int = 4
    width: float = 1.2
    hashes: int | None = None
    probes: int | None = None
    recall: float = 0.97
    sample_rows: int = 6_000
    sample_queries: int = 200
    most_probes: int = 128
    group_rows: int = 1_024
    seed: int = 42


def _projection(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([s.seed, dim])
    directions, offsets = rng.standard_normal((s.tables, s.hashes, dim)), rng.random((s.tables, s.hashes))
    odd = rng.integers(1, 2**62, size=(s.tables, s.hashes)) * 2 + 1
    return directions, offsets, odd


def _places(vectors: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places on the grids (rows, tables, hashes), and the odd numbers that make them one bucket."""
    directions, offsets, odd = _projection(vectors.shape[1], s)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.einsum("nd,thd->nth", unit, directions) / s.width + offsets, odd


def buckets(vectors: np.ndarray, s: Settings) -> np.ndarray:
    places, odd = _places(vectors, s)
    return (np.floor(places).astype(np.int64) * odd).sum(axis=2)


def probes(vectors: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, tables, probes) buckets, likeliest first: the best sums are built up hash by hash."""
    places, odd = _places(vectors, s)
    low = np.floor(places)
    inside = places - low
    score, bucket = np.zeros((*places.shape[:2], 1)), np.zeros((*places.shape[:2], 1), np.int64)
    for i in range(s.hashes):
        x, steps = inside[:, :, i, None], np.array([-2, -1, 0, 1, 2])
        far = np.concatenate([1 + x, x, np.zeros_like(x), 1 - x, 2 - x], axis=2) ** 2
        at = (low[:, :, i, None].astype(np.int64) + steps) * odd[None, :, i, None]
        score = (score[..., None] + far[:, :, None, :]).reshape(*places.shape[:2], -1)
        bucket = (bucket[..., None] + at[:, :, None, :]).reshape(*places.shape[:2], -1)
        order = np.argsort(score, axis=2, kind="stable")[:, :, : s.probes]
        score, bucket = np.take_along_axis(score, order, 2), np.take_along_axis(bucket, order, 2)
    return bucket


def fit(sample: np.ndarray, rows: int, k: int, s: Settings) -> Settings:
    """Hashes and probes with the least work for ``rows`` vectors among those that find ``recall`` of
    the sample's own nearest neighbours."""
    if len(sample) < 50:
        return replace(s, hashes=s.hashes or 2, probes=s.probes or s.most_probes)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    asked = np.arange(0, len(unit), max(1, len(unit) // s.sample_queries))
    cosines = unit[asked] @ unit.T
    cosines[np.arange(len(asked)), asked] = -2
    true = np.argsort(-cosines, axis=1)[:, :k]
    best = None
    for hashes in [s.hashes] if s.hashes else (2, 3, 4, 5, 6, 8, 10):
        t = replace(s, hashes=hashes, probes=s.probes or s.most_probes)
        own, visited = buckets(unit, t), probes(unit[asked], t)
        rank = np.full((len(asked), k), t.probes)
        share = np.zeros((len(asked), visited.shape[2]))
        for j in range(s.tables):
            hit = visited[:, j, :, None] == own[true, j][:, None, :]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), t.probes))
            values, counts = np.unique(own[:, j], return_counts=True)
            at = np.minimum(np.searchsorted(values, visited[:, j]), len(values) - 1)
            share += np.where(values[at] == visited[:, j], counts[at], 0) / len(unit)
        needed = s.probes or int(np.quantile(rank, s.recall, method="higher")) + 1
        if needed <= visited.shape[2] or best is None:
            needed = min(needed, visited.shape[2])
            cost = share[:, :needed].sum(axis=1).mean() * rows + needed * s.tables * 200 + (rank >= needed).mean() * 1e12
            if best is None or cost < best[0]:
                best = (cost, replace(t, probes=needed))
    return best[1]


def _by_dimension(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        m = np.stack(column.iloc[at].to_list()).astype(np.float64)
        # By a power of two, which changes no cosine and keeps squares of very small or large components in range.
        yield at, np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0, keepdims=True))[1])


def _nearest(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            sides = {m.shape[1]: (at, m) for at, m in _by_dimension(rows["v"])}
            ids = rows["vec_id"].to_numpy()
            for at, q in _by_dimension(queries["v"]):
                if q.shape[1] not in sides:
                    continue
                there, m = sides[q.shape[1]]
                order = np.argsort(ids[there], kind="stable")
                m, near = m[order], ids[there][order]
                size = np.linalg.norm(m, axis=1)
                # Where the vectors of each id begin, so that a repeated id takes one place.
                own_ids = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
                places = min(k, len(own_ids))
                for i in range(0, len(at), 256):
                    block, own = q[i : i + 256], queries["query"].to_numpy()[at[i : i + 256]]
                    norm = np.linalg.norm(block, axis=1)
                    score = block @ m.T / norm[:, None] / size
                    of_ids = np.maximum.reduceat(score, own_ids, axis=1) if len(own_ids) < len(near) else score
                    least = np.partition(of_ids, -places, axis=1)[:, -places]
                    a, b = np.nonzero((score >= least[:, None] - 1e-9) & np.isfinite(score))
                    exact = (block[a] * m[b]).sum(axis=1) / (norm[a] * size[b])
                    order = np.lexsort((-exact, near[b], a))
                    a, b, exact = a[order], b[order], exact[order]
                    best = np.append(True, (a[1:] != a[:-1]) | (near[b[1:]] != near[b[:-1]]))[: len(a)]
                    a, b, exact = a[best], b[best], exact[best]
                    order = np.lexsort((near[b], -exact, a))
                    a, b, exact = a[order], b[order], exact[order]
                    first = np.searchsorted(a, a)
                    kept = np.arange(len(a)) - first < k
                    out.append(pd.DataFrame({"query": own[a[kept]], "vec_id": near[b[kept]], "score": exact[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, object), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def _met(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    out = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_nearest(k), "query string, vec_id long, score double")
    return out.groupBy("query", "vec_id").agg(F.max("score").alias("score"))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows with an id and a vector that is finite in all places and not zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    return rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(finite & F.exists(v, lambda x: x != 0))


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (id, vector) the ``k`` nearest rows
    of ``df`` found, by largest cosine, ties to the smaller id; a row of the query's own id is left out.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part.
    Only vectors of the same length are compared. A repeated id counts with its nearest vector, on either
    side. A query for which the buckets hold no more than ``k`` rows, its own among them, is compared with all
    rows, exactly.
    Fitting, and finding such queries, are jobs that run when this is called.
    """
    # Of equal vectors only the k + 1 smallest ids can be among anyone's nearest, and equal queries have the same
    # k + 1 nearest, of which each then leaves out itself. So a group of copies is a few rows.
    same, k = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse("v")))), k + 1
    copies = Window.partitionBy("same").orderBy("vec_id")
    rows = usable(df, id_col, vector_col).groupBy(same.alias("same"), "vec_id").agg(F.first("v").alias("v"))
    rows = durable(rows.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k).select("vec_id", "v"))
    members = durable(usable(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), same.alias("query"), "v"))
    asked = members.groupBy("query").agg(F.first("v").alias("v"))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample_rows).select("v").toPandas()["v"]
    common = max(_by_dimension(sample), key=lambda x: len(x[0]), default=(None, np.zeros((0, 1))))[1] if len(sample) else np.zeros((0, 1))
    s = fit(common, total, k, settings)

    def spread(what):
        def run(column: pd.Series) -> pd.Series:
            out = np.empty(len(column), object)
            for at, m in _by_dimension(column):
                for i, found in zip(at, what(m, s).reshape(len(m), -1)):
                    out[i] = found
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, "array<long>")

    indexed = rows.select("vec_id", "v", F.posexplode(spread(buckets)(F.col("v"))).alias("table", "bucket"))
    probing = asked.select("query", "v", F.posexplode(spread(probes)(F.col("v"))).alias("at", "bucket"))
    per = min(s.probes, 5**s.hashes)
    probing = probing.select("query", "v", F.floor(F.col("at") / per).cast("int").alias("table"), "bucket")
    cell = ["table", "bucket"]
    parts = lambda n: F.ceil(F.col(n) / s.group_rows).cast("int")
    sizes = durable(
        indexed.groupBy(*cell).agg(F.count("*").alias("n")).join(probing.groupBy(*cell).agg(F.count("*").alias("m")), cell).select(*cell, parts("n").alias("rs"), parts("m").alias("qs"))
    )
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = indexed.join(sizes, cell).withColumn("r", part("vec_id", "rs")).select(*cell, "vec_id", "v", "r", each("qs").alias("q"))
    probing = probing.join(sizes, cell).withColumn("q", part("query", "qs")).select(*cell, "query", "v", "q", each("rs").alias("r"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")

    def answers(found: DataFrame) -> DataFrame:
        """Of each query's k + 1 nearest those that aren't itself."""
        own = members.select("query_id", "query").join(found.drop("rank"), "query").filter("query_id != vec_id")
        own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return own.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") < k).select("query_id", "rank", "vec_id", "score")

    found = durable(ranked(_met(probing, indexed, [*cell, "r", "q"], k)))
    short = durable(asked.join(found.filter(F.col("rank") == k), "query", "left_anti"))
    if short.isEmpty():
        return answers(found)
    all_parts = max(1, -(-total // s.group_rows))
    everything = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(all_parts)))
    query_parts = max(1, -(-short.count() // s.group_rows))
    everything = everything.select("vec_id", "v", "r", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("q"))
    again = short.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(query_parts)).cast("int")).select("query", "v", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(all_parts - 1).cast("bigint"))).alias("r"))
    exact = ranked(_met(again, everything, ["r", "q"], k))
    return answers(found.join(short.select("query"), "query", "left_anti").unionByName(exact))
