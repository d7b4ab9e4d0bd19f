"""Document fingerprints by consistent weighted sampling over words, in DataFrame functions alone.

A text is its words (lower case, between white space), each weighing as often as it occurs. For each of
``samples`` places every word draws r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with
weight S it takes t = floor(ln S / r + b), y = exp(r (t - b)) and a = c / (y exp(r)), and the word and t of the
least a are the text's sample there. Two texts agree in a place with the chance of their generalised
Jaccard similarity: the sum of the smaller weights by the sum of the larger ones.

The draws come in an order that costs little for what occurs once. A Gamma(2, 1) splits into two exponentials
at a uniform point, so a1 ~ Exp(1) is drawn first, then c = a1 + e, exp(-w1) = a1 / c, r = w1 + w2 and b = w2 / r.
Then a = a1 exp(-r t), and S = 1 has t = 0. The least a is kept as the greatest exp(-a), a uniform number for
S = 1 without any logarithm. The number itself stands for the word and its t.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

_AT_ONCE = 8
_SPACES = "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(F.translate(text, _SPACES, " " * len(_SPACES)), F.lit(""))), " ")


def _draw(h: Column, tf: Column, log_tf: Column) -> Column:
    """exp(-a) of a word's draw ``h`` at weight ``tf``, as a number below 2^62; null for weight 0."""
    uniform = lambda x: (F.shiftrightunsigned(x, 2) + F.lit(0.5)) * F.lit(2.0**-62)
    exponential = lambda x: -F.log(uniform(x))
    second = F.xxhash64(h)
    a1, e, w2 = exponential(h), exponential(second), exponential(F.xxhash64(second))
    r = F.greatest(F.log((a1 + e) / a1) + w2, F.lit(1e-12))
    a = a1 * F.exp(-r * F.greatest(F.floor((log_tf + w2) / r), F.lit(1)))
    # t is 0 if e > (S - 1) a1, so if exp(-e) < exp(-a1)^(S - 1); for S = 2 that needs no arithmetic. Then the number is S = 1's.
    first = (tf == 1) | F.when(tf == 2, F.shiftrightunsigned(second, 2) < F.shiftrightunsigned(h, 2)).otherwise(uniform(second) < F.pow(uniform(h), tf - 1))
    return F.when(tf == 0, F.lit(None)).when(first, F.shiftrightunsigned(h, 2)).otherwise((F.exp(-a) * F.lit(2.0**62)).cast("bigint"))


def signatures(pieces: DataFrame, keys: list[str], samples: int = 64, seed: int = 42, carry: str | None = None) -> DataFrame:
    """(keys, first, second: array<int> of ``samples`` numbers), from rows (keys, text, in_first, in_second).

    The rows of a key are pieces of up to two texts, each a run of whole words: a piece counts in the first, in
    the second or in both. A text without words has zeros. ``carry`` names a column that is null but in one
    row of a key, whose value comes back. ``samples`` is rounded up to a multiple of 8. Rows that are already
    dealt out by one of ``keys`` aren't shuffled; else words are counted before they are.
    """
    carried = [carry] if carry else []
    words = pieces.select(*keys, *carried, "in_first", "in_second", F.explode(_words(F.col("text"))).alias("word"))
    terms = words.select(*keys, *carried, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), F.col("in_first").cast("int").alias("in_first"), F.col("in_second").cast("int").alias("in_second"))
    counted = terms.groupBy(*keys, *carried, "term").agg(F.sum("in_first").alias("n1"), F.sum("in_second").alias("n2"))
    rng = random.Random(seed)
    parts = [rng.getrandbits(62) for _ in range(-(-samples // _AT_ONCE))]
    salts = [0, *(rng.getrandbits(62) for _ in range(_AT_ONCE - 1))]
    log = lambda n: F.log(F.greatest(n, F.lit(1)).cast("double"))
    counted = counted.select(*keys, *carried, "term", "n1", "n2", log(F.col("n1")).alias("log1"), log(F.col("n2")).alias("log2"))
    each = counted.select(*keys, *carried, "n1", "n2", "log1", "log2", "term", F.explode(F.array(*map(F.lit, parts))).alias("part"))
    each = each.withColumn("base", F.col("term").bitwiseXOR(F.col("part")))
    hashes = [F.xxhash64(F.col("base").bitwiseXOR(F.lit(s))) for s in salts]
    known = lambda c: F.when(F.col("term").isNotNull(), c)
    best = each.groupBy(*keys, *carried, "part").agg(
        *(F.max(known(_draw(h, F.col(n), F.col(f"log{n[1]}")))).alias(f"{n}_{i}") for i, h in enumerate(hashes) for n in ("n1", "n2"))
    )
    number = lambda c: F.when(F.col(c).isNotNull(), F.hash(c)).otherwise(0)
    row = F.struct(F.array_position(F.array(*map(F.lit, parts)), F.col("part")).alias("at"), *(F.array(*(number(f"{n}_{i}") for i in range(_AT_ONCE))).alias(n) for n in ("n1", "n2")))
    own = F.when(F.col(carry).isNull(), row) if carry else row
    found = best.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("rows"), *(F.first(c, ignorenulls=True).alias(c) for c in carried))
    return found.select(*keys, *carried, F.flatten(F.col("rows.n1")).alias("first"), F.flatten(F.col("rows.n2")).alias("second"))


def likeness(a: Column, b: Column) -> Column:
    """The share of places in which two signatures agree: about the texts' generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def shown(signature: Column) -> Column:
    """A signature as a string: 8 lower-case hex digits a place."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 64, seed: int = 42) -> DataFrame:
    """(id, text_hash, signature) for each different (id, text) of ``df``; compare them with ``likeness``.

    A null text counts as empty; an empty text, or one of white space, has zeros only and so is like another of
    that kind. A null id is an id. Repeated rows give one row; other columns are left out.
    """
    pieces = df.select(
        F.col(f"`{id_col}`").alias(id_col), F.xxhash64(F.coalesce(f"`{text_col}`", F.lit(""))).alias("text_hash"), F.col(f"`{text_col}`").alias("text"),
        F.lit(True).alias("in_first"), F.lit(False).alias("in_second"),
    ).dropDuplicates([id_col, "text_hash"])
    return signatures(pieces, [id_col, "text_hash"], samples, seed).select(f"`{id_col}`", "text_hash", F.col("first").alias("signature"))


_PER_BUCKET = 6  # as a power of two, in ids


def _bucket(key: Column, order: Column) -> Column:
    """Buckets of 64 neighbouring ids; null ids are the last, in buckets by the text's hash."""
    return F.when(key.isNull(), F.lit(-(2**62)) + F.shiftrightunsigned(order, 40)).otherwise(F.shiftright(key, _PER_BUCKET))


def _before(buckets: DataFrame) -> DataFrame:
    """(bucket, host): of distinct buckets each with the next larger one; the largest has the smallest as host.

    Ranges of buckets are numbered once and written; a window runs within each, and one more over the ranges."""
    ranges = durable(buckets.repartitionByRange(F.desc("bucket")).select("bucket", F.spark_partition_id().alias("range")))
    edges = ranges.groupBy("range").agg(F.min("bucket").alias("least"))
    by_range = Window.orderBy("range")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("range", F.coalesce(F.lag("least").over(by_range), F.last("least").over(whole)).alias("outer"))
    inner = ranges.withColumn("inner", F.lag("bucket").over(Window.partitionBy("range").orderBy(F.desc("bucket"))))
    return inner.join(edges, "range").select("bucket", F.coalesce("inner", "outer").alias("host"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", replaced: int = 3, samples: int = 64, seed: int = 42) -> DataFrame:
    """Each text beside its edited text, whose last floor(n_chars / ``replaced``) characters are the first as many
    (or all, if it has fewer) of the next document's: (id, n_chars, edited_sha256, signature, edited, near_edited,
    near_next).

    The next document has the next smaller id; after the last comes the first. Rows of one id stand in the order of
    their texts' hashes, null ids last. A null text is empty; an empty table gives an empty result; a single row
    is its own next one. Other columns are left out. Rows of 64 neighbouring ids meet in one place, with the first text
    of the next such place, so a text crosses the network once; the rows of one repeated id stay together. Buckets and
    signatures are written when this is called.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = F.xxhash64(text)
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"), order.alias("h"))
    docs = docs.withColumn("bucket", _bucket(F.col("id"), F.col("h")))
    hosts = durable(_before(docs.select("bucket").distinct()))
    in_order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), F.desc("h"))
    placed = docs.select("bucket", "id", "text", F.row_number().over(in_order).alias("n"), F.lead("text").over(in_order).alias("next"))
    guests = lambda what, value: what.filter("n = 1").select("bucket", value).join(hosts, "bucket").select(F.col("host").alias("bucket"), F.col(value).alias("guest"))
    paired = placed.join(guests(placed, "text"), "bucket").withColumn("next", F.coalesce("next", "guest"))

    n_chars = F.length("text")
    cut = F.floor(n_chars / replaced).cast("int")
    head, more = F.left("text", n_chars - cut), F.left("next", cut)
    texts = paired.select("bucket", "n", "id", "text", head.alias("head"), more.alias("more"), n_chars.cast("bigint").alias("n_chars"))
    # The words that the cut leaves whole count in both texts; the word at the cut belongs to what follows it.
    broken = F.length(F.substring_index(F.translate("head", _SPACES, " " * len(_SPACES)), " ", -1))
    texts = texts.withColumn("kept", F.length("head") - broken)
    info = F.struct("id", "n_chars", F.sha2(F.concat("head", "more"), 256).alias("edited_sha256"))
    piece = lambda text, a, b, info=F.lit(None): F.struct(text.alias("text"), F.lit(a).alias("in_first"), F.lit(b).alias("in_second"), info.alias("info"))
    none = F.lit(None).cast("struct<id:bigint,n_chars:bigint,edited_sha256:string>")
    pieces = texts.select("bucket", "n", F.inline(F.array(
        piece(F.expr("left(head, kept)"), True, True, none),
        piece(F.expr("substring(text, kept + 1)"), True, False, none),
        piece(F.concat(F.expr("substring(head, kept + 1)"), "more"), False, True, none),
        piece(F.lit(""), False, False, info),
    )))
    signed = durable(signatures(pieces, ["bucket", "n"], samples, seed, carry="info"))
    by_n = Window.partitionBy("bucket").orderBy("n")
    near = signed.withColumn("next", F.lead("first").over(by_n)).join(guests(signed, "first"), "bucket").withColumn("next", F.coalesce("next", "guest"))
    return near.select(
        F.col("info.id").alias(id_col), F.col("info.n_chars").alias("n_chars"), F.col("info.edited_sha256").alias("edited_sha256"),
        F.col("first").alias("signature"), F.col("second").alias("edited"), likeness(F.col("first"), F.col("second")).alias("near_edited"), likeness(F.col("first"), F.col("next")).alias("near_next"),
    )
