"""Uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix.

1. The rows are written to the checkpoint folder; the partitions that they have there are the blocks.
2. For each block the number of its rows that go to each shard is drawn exactly: a binary tree over
   the blocks splits the shards' sizes in two with hypergeometric draws, level by level.
3. Each block permutes its rows where they are and cuts the permutation at the drawn counts.
4. After the exchange, the only one of the rows, each shard permutes what it got; a row's place is its slot.

Every assignment of rows to shards with the prescribed sizes is equally likely, whatever the sizes
of the blocks. Draws come from hashes of the seed, so a lost task draws the same numbers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, packed, uniform, unpacked

#: One hypergeometric draw: of d.t rows d.k are marked, d.n are taken, how many of those are marked?
#: Inversion of the distribution function, from the mode upwards and then downwards; beyond 12
#: standard deviations the weight is below what a double resolves.
_RATIO = (
    "IF(k > e.mode, (d.k - k + 1) * (d.n - k + 1) / (k * (d.t - d.k - d.n + k)),"
    " (k + 1) * (d.t - d.k - d.n + k + 1) / ((d.k - k) * (d.n - k)))"
)
_WEIGHT = f"IF(k = e.mode, 1D, IF(k = e.mode - 1, 1D, a.w) * {_RATIO})"
_DRAW = f"""
transform(array(named_struct(
  't', CAST(s.t AS DOUBLE), 'k', CAST(m[i] AS DOUBLE), 'n', CAST(s.n AS DOUBLE),
  'lo', greatest(0L, s.n - (s.t - m[i])), 'hi', least(m[i], s.n),
  'u', shiftrightunsigned(xxhash64(seed, first_block, size(sizes), i), 11) / 9007199254740992D)), d ->
IF(d.lo >= d.hi, d.lo, transform(array(named_struct(
  'mode', least(d.hi, greatest(d.lo, CAST(floor((d.n + 1) * (d.k + 1) / (d.t + 2)) AS BIGINT))),
  'reach', CAST(ceil(12 * sqrt(d.n * (d.k / d.t) * (1 - d.k / d.t) * (d.t - d.n) / greatest(1D, d.t - 1))) AS BIGINT) + 2)), e ->
transform(array(concat(
  sequence(e.mode, least(d.hi, e.mode + e.reach)),
  IF(e.mode > d.lo, sequence(e.mode - 1, greatest(d.lo, e.mode - e.reach), -1L), CAST(array() AS ARRAY<BIGINT>)))), ks ->
transform(array(d.u * aggregate(ks, named_struct('w', 1D, 'z', 0D),
    (a, k) -> transform(array({_WEIGHT}), w -> named_struct('w', w, 'z', a.z + w))[0], a -> a.z)), target ->
aggregate(ks, named_struct('w', 1D, 'z', 0D, 'at', CAST(NULL AS BIGINT)),
    (a, k) -> transform(array({_WEIGHT}), w -> named_struct('w', w, 'z', a.z + w, 'at', coalesce(a.at, IF(a.z + w > target, k, NULL))))[0],
    a -> coalesce(a.at, e.mode)))[0])[0])[0]))[0]"""
#: For the left half of the blocks: how many rows of each shard's quota come from it.
_LEFT = f"""
aggregate(sequence(0, size(m) - 1), named_struct('t', total, 'n', left_rows, 'out', CAST(array() AS ARRAY<BIGINT>)),
  (s, i) -> transform(array({_DRAW}), x -> named_struct('t', s.t - m[i], 'n', s.n - x, 'out', concat(s.out, array(x))))[0],
  s -> s.out)"""


def communication_matrix(counts: DataFrame, n_shards: int, blocks: int, seed: int) -> DataFrame:
    """(block, upto array<bigint>): row ``block`` of the matrix, summed up along the shards.

    ``counts`` is (block, rows) for blocks 0 to ``blocks``-1 (a power of two, from 1); absent ones are empty.
    Shard sizes differ by one at most. The tree has ``log2(blocks)`` levels, each a narrow step.
    """
    sizes = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), F.col("rows").cast("bigint")))).alias("by"))
    tree = sizes.select(
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(0).alias("first_block"),
        F.expr(f"transform(sequence(0, {blocks - 1}), b -> coalesce(try_element_at(by, b), 0L))").alias("sizes"),
    ).withColumn("total", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))
    tree = tree.withColumn("m", F.expr(f"transform(sequence(0, {n_shards - 1}), s -> CAST(total div {n_shards} + IF(s < total % {n_shards}, 1, 0) AS BIGINT))"))
    half = blocks // 2
    while half:
        tree = (
            tree.withColumn("left_rows", F.expr(f"aggregate(slice(sizes, 1, {half}), 0L, (a, x) -> a + x)"))
            .withColumn("left_m", F.expr(_LEFT))
            .select("seed", F.expr(f"""inline(array(
                named_struct('first_block', first_block, 'sizes', slice(sizes, 1, {half}), 'total', left_rows, 'm', left_m),
                named_struct('first_block', first_block + {half}, 'sizes', slice(sizes, {half + 1}, {half}), 'total', total - left_rows,
                             'm', zip_with(m, left_m, (x, y) -> x - y))))"""))
        )
        half //= 2
    return tree.select(
        F.col("first_block").alias("block"),
        F.expr("aggregate(m, CAST(array() AS ARRAY<BIGINT>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + x)))").alias("upto"),
    )


def shuffle_into_shards(df: DataFrame, n_shards: int = 40, seed: int = 42, rows_per_sort: int = 250_000, most_broadcast: int = 4_000_000) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to n_shards-1) and ``slot`` (long, gapless from 0 in each shard).

    Law ``rows``: shard sizes differ by one at most and the assignment is uniform among all of that
    kind. Rows count as they come: nulls, equal rows and repeated keys each get a place of their own,
    an empty table gives an empty result, and input columns named shard or slot are replaced. The
    second permutation sorts about ``rows_per_sort`` rows at a time; a matrix of up to ``most_broadcast``
    numbers is broadcast to the blocks, a larger one joined by shuffle. Select the columns that are needed first:
    the rows are written twice and exchanged once. Writing and drawing are jobs that run when this is called.
    """
    columns = df.columns
    rows = durable(df.select(packed(df), F.monotonically_increasing_id().alias("__row")))
    # The number says which partition a row was written in, and it is read in that partition again.
    block, within = F.shiftright("__row", 33).cast("int").alias("block"), F.lit(2**33 - 1)
    counts = durable(rows.groupBy(block).agg(F.count("*").alias("rows")))
    total, last = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("block"), F.lit(0))).first()
    blocks = 1
    while blocks <= last:
        blocks *= 2
    sub = max(4, -(-total // (n_shards * rows_per_sort)))
    matrix = durable(communication_matrix(counts, n_shards, blocks, seed))
    permuted = rows.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), "__row"), "__row")
    permuted = permuted.select("__in", "__row", block, (F.monotonically_increasing_id().bitwiseAND(within) + 1).alias("place"))
    dealt = (
        permuted.join(F.broadcast(matrix) if blocks * n_shards <= most_broadcast else matrix.hint("merge"), "block")
        .select("__in", "__row", F.expr("size(filter(upto, x -> x < place))").alias("shard"), uniform(F.lit(seed + 2), F.col("__row")).alias("draw"))
        .withColumn("sub", F.floor(F.col("draw") * sub).cast("int"))
    )
    dealt = durable(dealt)
    before = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n"))
    again = Window.partitionBy("shard", "sub").orderBy("draw", "__row")
    return (
        dealt.withColumn("at", F.row_number().over(again))
        .join(before.select("shard", "sub", "before").hint("merge"), ["shard", "sub"])
        .select(*unpacked(columns, ("shard", "slot")), "shard", (F.col("before") + F.col("at") - 1).cast("bigint").alias("slot"))
    )
