"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

For each class the highest order has counts of its own; below it both classes share one chain of
Kneser-Ney continuation counts, so what neither class has seen often is worth nothing either way.
A word's value is the difference of its toxic and ordinary log-likelihoods. A document is scored by
the mean over its words and by how far its most telling words stand out, as a logistic model weighs them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, unpacked

_WORD = re.compile(r"[^\W\d_]+")
_FEATURES = "mean double, most double, excess double, n double"


@dataclass(frozen=True)
class Settings:
    """``order``: characters of an n-gram. ``fit_rows``: at most so many labelled rows fit the four weights of the logistic
    model. ``stand_out``: log ratio beyond which a word counts as telling. ``broadcast_labels``: with more labels than
    that they are joined by shuffle. ``broadcast_grams``: with more n-grams and contexts than that, taken together (12 bytes
    each), the words' values are joined by shuffle."""

    order: int = 5
    discount: float = 0.75
    fit_rows: int = 20_000
    stand_out: float = 3.0
    broadcast_labels: int = 2_000_000
    broadcast_grams: int = 20_000_000


@dataclass
class Table:
    """Values by the sorted 64-bit hashes of all keys; what is not in it has the value ``missing``."""

    keys: np.ndarray
    values: np.ndarray
    missing: float

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.missing, np.float64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at].astype(np.float64), self.missing)


@dataclass
class Model:
    gram: Table
    context: Table
    settings: Settings


def _grams(word: str, order: int) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked)))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            if text:
                found[int(toxic)].update(_WORD.findall(text.lower()))
        words = list(found[0].keys() | found[1].keys())
        yield pd.DataFrame({"word": words, "n0": [found[0][w] for w in words], "n1": [found[1][w] for w in words]})


def _gram_counts(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n0, n1 = Counter(), Counter()
            for word, a, b in zip(batch["word"], batch["n0"].tolist(), batch["n1"].tolist()):
                for g in _grams(word, order):
                    n0[g] += a
                    n1[g] += b
            yield pd.DataFrame({"g": list(n0), "n0": list(n0.values()), "n1": [n1[g] for g in n0]})

    return run


def language_models(labelled: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Both classes' models from (text, toxic 0 or 1), as one table (k, v) of log ratios for n-grams and one
    for contexts whose next character was not seen; k is the 64-bit hash. All counts are sums over all rows."""
    words = labelled.mapInPandas(_word_counts, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = words.mapInPandas(_gram_counts(settings.order), "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = durable(grams.select("g", F.expr("left(g, length(g) - 1)").alias("h"), F.expr("right(g, 1)").alias("x"), "n0", "n1"))
    d, tail = settings.discount, lambda k: F.expr(f"right(h, {k})" if k else "substring(h, 1, 0)")
    levels, rows = [], grams.select("h", "x")
    for k in range(settings.order - 2, -1, -1):
        rows = rows.groupBy(tail(k).alias("h"), "x").agg(F.count("*").alias("n"))
        levels.append((k, rows))
    characters = grams.select("x").distinct().count()
    shared = None
    for k, rows in reversed(levels):
        total = rows.groupBy("h").agg(F.sum("n").alias("t"), F.count("*").alias("types"))
        rows = rows.join(total, "h").withColumn("below", tail(max(0, k - 1)))
        if shared is None:
            low = F.lit(1.0 / (characters + 1))
        else:
            rows, low = rows.join(shared, ["below", "x"]), F.col("p_below")
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * low) / F.col("t")
        shared = durable(rows.select(F.col("h").alias("below"), "x", p.alias("p_below")))
    contexts = grams.groupBy("h").agg(
        F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum((F.col("n0") > 0).cast("int")).alias("k0"), F.sum((F.col("n1") > 0).cast("int")).alias("k1")
    )

    def back(c: int) -> Column:
        return F.when(F.col(f"t{c}") > 0, d * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0)

    def probability(c: int) -> Column:
        seen = F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0)
        return seen + back(c) * F.col("p_below")

    table = lambda rows, key, value: durable(rows.select(F.xxhash64(key).alias("k"), value.cast("float").alias("v")))
    full = grams.withColumn("below", tail(settings.order - 2)).join(shared, ["below", "x"]).join(contexts, "h")
    return table(full, "g", F.log(probability(1) / probability(0))), table(contexts, "h", F.log(back(1) / back(0)))


def held_model(grams: DataFrame, contexts: DataFrame, settings: Settings) -> Model:
    """The two tables of ``language_models`` in memory, for a bounded number of n-grams."""

    def table(rows: DataFrame, missing: float) -> Table:
        held = rows.toArrow()
        keys, values = held["k"].to_numpy().view(np.uint64), held["v"].to_numpy()
        order = np.argsort(keys)
        return Table(keys[order], values[order], missing)

    return Model(table(grams, np.nan), table(contexts, 0.0), settings)


def word_values(model: Model, words: list[str]) -> np.ndarray:
    """Each word's value: its n-grams' log ratios, and for those not seen their contexts'."""
    digest, grams = xxhash.xxh64_intdigest, [list(_grams(w, model.settings.order)) for w in words]
    flat = [g for found in grams for g in found]
    hashes = lambda texts: np.array([digest(t, 42) for t in texts], np.uint64)
    v = model.gram.get(hashes(flat))
    unseen = np.flatnonzero(np.isnan(v))
    v[unseen] = model.context.get(hashes([flat[i][:-1] for i in unseen]))
    return np.bincount(np.repeat(np.arange(len(words)), [len(found) for found in grams]), v, len(words))


def word_value(model: Model, word: str) -> float:
    return float(word_values(model, [word])[0])


def features(text: Column, model: Broadcast, cached_words: int = 100_000, cached_chars: int = 4_000_000) -> Column:
    """struct<mean, most, excess, n> of each whole text; null and empty texts have zeros. A worker keeps the values of words
    until there are ``cached_words``, or ``cached_chars`` characters in them; beside these it holds one text's."""

    @F.pandas_udf(_FEATURES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, known, chars = model.value, {}, 0
        line = held.settings.stand_out
        for batch in batches:
            out = np.zeros((len(batch), 4))
            for i, text in enumerate(batch):
                words = _WORD.findall(text.lower()) if text else []
                if words:
                    if len(known) > cached_words or chars > cached_chars:
                        known.clear()
                        chars = 0
                    new = list(set(words).difference(known))
                    if new:
                        known.update(zip(new, word_values(held, new).tolist()))
                        chars += sum(map(len, new))
                    v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    out[i] = v.mean(), v.max(), np.maximum(v - line, 0).sum(), len(words)
            yield pd.DataFrame(out, columns=["mean", "most", "excess", "n"])

    return run(text)


def _document_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in batch["text"]]
        sizes, side = [len(c) for c in found], {"word": [w for c in found for w in c], "n": [n for c in found for n in c.values()]}
        yield pd.DataFrame({"k1": np.repeat(batch["k1"].to_numpy(), sizes), "k2": np.repeat(batch["k2"].to_numpy(), sizes)} | side)


def _word_grams(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, g) for w in batch["word"] for g in _grams(w, order)]
            yield pd.DataFrame({"word": [w for w, _ in rows], "g": [g for _, g in rows]})

    return run


def joined_features(df: DataFrame, text: Column, grams: DataFrame, contexts: DataFrame, settings: Settings) -> DataFrame:
    """``df`` with ``f`` as from ``features``, by joins alone: the documents' distinct words take their values from
    the n-grams' tables, and each distinct text its features from its words."""
    keyed = df.withColumn("__text", text).withColumn("k1", F.xxhash64("__text")).withColumn("k2", F.xxhash64(F.lit("2"), F.reverse(F.coalesce("__text", F.lit("")))))
    texts = keyed.select("k1", "k2", F.col("__text").alias("text")).dropDuplicates(["k1", "k2"])
    words = durable(texts.mapInPandas(_document_words, "k1 long, k2 long, word string, n long"))
    pairs = words.select("word").distinct().mapInPandas(_word_grams(settings.order), "word string, g string")
    pairs = pairs.withColumn("k", F.xxhash64("g")).join(grams.withColumnRenamed("v", "seen"), "k", "left").drop("k")
    pairs = pairs.withColumn("k", F.xxhash64(F.expr("left(g, length(g) - 1)"))).join(contexts, "k", "left")
    values = pairs.groupBy("word").agg(F.sum(F.coalesce("seen", "v", F.lit(0.0)).cast("double")).alias("v"))
    n, v = F.col("n"), F.col("v")
    told = words.join(values, "word").groupBy("k1", "k2").agg(
        (F.sum(n * v) / F.sum(n)).alias("mean"), F.max(v).alias("most"), F.sum(n * F.greatest(v - settings.stand_out, F.lit(0.0))).alias("excess"), F.sum(n).cast("double").alias("n")
    )
    names = ("mean", "most", "excess", "n")
    f = F.struct(*(F.coalesce(x, F.lit(0.0)).alias(x) for x in names)).alias("f")
    return keyed.join(told, ["k1", "k2"], "left").select(*(F.col(f"`{c}`") for c in df.columns), f)


def _scaled(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), f[:, 0].clip(-2, 2), f[:, 1].clip(0, 20), np.log1p(f[:, 2]), np.log1p(f[:, 3])])


def logistic_weights(f: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method on the scaled features."""
    x, w = _scaled(f), np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(5), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(df: DataFrame, labelled_docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (double, 0 to 1, higher: likelier toxic), from every whole text.

    Learns from rows of ``labelled_docs`` (id, text) whose id has a row in ``labels`` (id, toxic) and
    crc32(id as text) mod 3 other than 1; of a fifth of them the ``fit_rows`` first by hash fit the logistic
    weights, all others the language models. Of repeated labels the largest counts, null labels and ids count as
    none, null and empty texts have no words. Without labels of both classes every score is 0. A column named
    score is replaced. Learning is a few jobs, which run when this is called.
    """
    spark = df.sparkSession
    ident = F.col(f"`{id_col}`")
    labels = labels.select(ident.alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    labels = durable(labels.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).groupBy("id").agg(F.max("toxic").alias("toxic")))
    side = F.broadcast(labels) if labels.count() <= settings.broadcast_labels else labels
    rows = labelled_docs.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text")).join(side, "id")
    columns = df.columns
    given_rows = df.select(packed(df))
    unscored = given_rows.select(*unpacked(columns, ("score",)), F.lit(0.0).alias("score"))
    if labels.select("toxic").distinct().count() < 2:
        return unscored
    fits = F.crc32(F.concat(F.lit("fit"), F.col("id").cast("string")).cast("binary")) % 5 == 0
    first = [F.xxhash64("id"), F.col("id")]
    chosen = durable(rows.filter(fits).select("id").distinct().orderBy(*first).limit(settings.fit_rows).withColumn("fit", F.lit(True)))
    rows = rows.join(F.broadcast(chosen), "id", "left")
    grams, contexts = language_models(rows.filter("fit IS NULL").select("text", "toxic"), settings)
    if grams.count() + contexts.count() <= settings.broadcast_grams:
        held = spark.sparkContext.broadcast(held_model(grams, contexts, settings))
        with_features = lambda given, text: given.withColumn("f", features(text, held))
    else:
        with_features = lambda given, text: joined_features(given, text, grams, contexts, settings)
    sample = rows.filter("fit").orderBy(*first).limit(settings.fit_rows).select("toxic", "text")
    given = with_features(sample, F.col("text")).select("toxic", "f.*").toPandas()
    if given["toxic"].nunique() < 2:
        return unscored
    w = logistic_weights(given[["mean", "most", "excess", "n"]].to_numpy(float), given["toxic"].to_numpy(float))
    f = F.col("f")
    clipped = lambda c, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))
    z = F.lit(float(w[0])) + clipped(f["mean"], -2, 2) * float(w[1]) + clipped(f["most"], 0, 20) * float(w[2]) + F.log1p(f["excess"]) * float(w[3]) + F.log1p(f["n"]) * float(w[4])
    scored = with_features(given_rows, F.col(f"__in.`{text_col}`"))
    return scored.select(*unpacked(columns, ("score",)), (1 / (1 + F.exp(-z))).alias("score"))
