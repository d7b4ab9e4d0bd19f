from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioframe.llm.sharding import communication_matrix, shuffle_into_shards


def test_matrix_has_the_given_sums(spark):
    sizes = [0, 5, 1000, 3, 70000, 1, 0, 12]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block int, rows long")
    rows = {r.block: np.diff([0, *r.upto]) for r in communication_matrix(counts, 7, 8, 1).collect()}
    total = sum(sizes)
    assert [int(rows[i].sum()) for i in range(8)] == sizes
    assert all((rows[i] >= 0).all() for i in range(8))
    shards = sum(rows.values())
    assert sorted(shards.tolist()) == sorted(total // 7 + (i < total % 7) for i in range(7))


def test_matrix_is_hypergeometric(spark):
    """Of 4 and 6 rows over 2 shards: the first block's share of shard 0 by its exact distribution."""
    counts = spark.createDataFrame([(0, 4), (1, 6)], "block int, rows long")
    seen = Counter()
    for seed in range(150):
        upto = communication_matrix(counts, 2, 2, seed).filter("block = 0").first().upto
        seen[upto[0]] += 1
    want = {0: 6, 1: 60, 2: 120, 3: 60, 4: 6}
    chi = sum((seen[k] - 150 * v / 252) ** 2 / (150 * v / 252) for k, v in want.items())
    assert chi < 25


def test_shards_are_exact_and_repeatable(spark):
    df = spark.range(1003).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("slot"), F.lit(None).cast("string").alias("__row"))
    out = shuffle_into_shards(df, 40, rows_per_sort=10)
    rows = out.toPandas()
    assert list(out.columns) == ["doc_id", "__row", "shard", "slot"]
    assert len(rows) == 1003 and rows["doc_id"].isna().sum() == 335
    assert set(rows.groupby("shard").size()) == {25, 26} and rows["shard"].nunique() == 40
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    again = shuffle_into_shards(df, 40, rows_per_sort=10).toPandas()
    key = ["shard", "slot"]
    assert rows.sort_values(key)["doc_id"].fillna(-1).tolist() == again.sort_values(key)["doc_id"].fillna(-1).tolist()


def test_blocks_of_any_size_permute_where_they_are(spark):
    """One exchange of rows; a row's shard doesn't depend on where it stands in the input."""
    df = spark.range(0, 4000, 1, 1).union(spark.range(4000, 4010, 1, 3)).union(spark.range(4010, 6000, 1, 7))
    out = shuffle_into_shards(df, 8, most_broadcast=10**6).toPandas()
    again = shuffle_into_shards(df, 8, most_broadcast=0).toPandas()
    assert out.sort_values("id").values.tolist() == again.sort_values("id").values.tolist()
    assert out.groupby("shard").size().tolist() == [750] * 8 and all(sorted(g) == list(range(750)) for _, g in out.groupby("shard")["slot"])
    for part in (out[out.id < 4000], out[out.id >= 4010]):
        want = len(part) / 8
        assert (((part.groupby("shard").size() - want) ** 2) / want).sum() < 24
    halves = out.assign(first=out.id < 2000, early=out.slot < 375)
    assert abs(halves[halves["first"]].early.mean() - 0.5) < 0.05


def test_empty_and_few_rows(spark):
    assert shuffle_into_shards(spark.range(0), 40).count() == 0
    rows = shuffle_into_shards(spark.range(3), 40).collect()
    assert len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}
