"""Line dedup with overlapping windows of three lines.

A window is three consecutive lines of one document. Windows that occur more than once in the corpus
are found by a 128-bit hash; all lines under later occurrences go, the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, packed


def remove_repeated_lines(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text's repeated windows removed, plus ``n_lines`` and ``n_removed`` (int).

    Lines are split at ``\\n``. The first occurrence is the one with the smallest (doc_id, position);
    null ids come first. Later windows may overlap: the covered positions are merged. A text of fewer
    than ``width`` lines has no window and stays. Rows equal in id and text are one document and come
    out alike. Null text stays null with 0 lines. If all lines go, the text is empty. Columns of the
    input named n_lines or n_removed are replaced.
    """
    columns = df.columns
    docs = df.select(packed(df), identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("k")).select("__in", F.col("k.h1").alias("k1"), F.col("k.h2").alias("k2"))
    text, doc = F.col(f"__in.`{text_col}`"), F.col(f"__in.`{id_col}`")
    window = [f"lines[i + {k}]" for k in range(width)]
    hashes = f"transform(slice(lines, {width}, size(lines)), (x, i) -> struct(xxhash64({', '.join(window)}) AS h1, xxhash64({width}, {', '.join(window[::-1])}) AS h2))"
    occurrences = (
        docs.select("k1", "k2", doc.alias("doc"), F.split(text, "\n", -1).alias("lines"))
        .filter(F.size("lines") >= width)
        .select("k1", "k2", "doc", F.posexplode(F.expr(hashes)).alias("at", "h"))
        .select(F.struct("doc", "k1", "k2", "at").alias("o"), "h.h1", "h.h2")
    )
    repeated = occurrences.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first != last").select("h1", "h2", "first")
    covered = (
        occurrences.join(repeated, ["h1", "h2"])
        .filter("o > first")
        .groupBy(F.col("o.k1").alias("k1"), F.col("o.k2").alias("k2"))
        .agg(F.collect_set("o.at").alias("starts"))
    )
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    done = docs.join(covered, ["k1", "k2"], "left").withColumn("lines", F.split(text, "\n", -1)).withColumn("gone", gone)
    kept = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    new_text = F.when(F.col("starts").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return done.select(
        *[new_text.alias(c) if c == text_col else F.col(f"__in.`{c}`").alias(c) for c in columns if c not in ("n_lines", "n_removed")],
        F.when(text.isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
