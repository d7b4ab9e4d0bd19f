"""Selected pages as a set (doc_id, page_id) with an anchor (doc_id, page_id) for each document.

Pages stay selected after they are deleted by something else; counts include them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .manifest import delete, rotate

_KEYS = ["doc_id", "page_id"]


def select_single(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``clicks`` has one page for a document: it is the selection and the anchor."""
    one = clicks.select(*_KEYS)
    return one, one


def toggle(selection: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each click (doc_id, seq, page_id) puts a page in or takes it out; the last one is the anchor."""
    both = selection.select(*_KEYS).distinct().unionByName(clicks.select(*_KEYS))
    chosen = both.groupBy(*_KEYS).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*_KEYS)
    return chosen, clicks.groupBy("doc_id").agg(F.max_by("page_id", "seq").alias("page_id"))


def select_range(manifest: DataFrame, anchors: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pages from the anchor to the end, either way; they replace the selection, the anchor stays.

    Without an anchor, or if either page isn't there, the end alone is selected and is the anchor.
    """
    at = manifest.select("doc_id", "page_id", "position")
    ends = ends.select("doc_id", F.col("page_id").alias("end_id")).join(anchors.select("doc_id", F.col("page_id").alias("anchor_id")), "doc_id", "left")
    ends = ends.join(at.select("doc_id", F.col("page_id").alias("end_id"), F.col("position").alias("b")), ["doc_id", "end_id"], "left")
    ends = ends.join(at.select("doc_id", F.col("page_id").alias("anchor_id"), F.col("position").alias("a")), ["doc_id", "anchor_id"], "left")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    spans = at.join(ends.filter(whole).select("doc_id", "a", "b"), "doc_id")
    chosen = spans.filter(F.col("position").between(F.least("a", "b"), F.greatest("a", "b"))).select(*_KEYS)
    single = ends.filter(~whole).select("doc_id", F.col("end_id").alias("page_id"))
    return chosen.unionByName(single), ends.select("doc_id", F.when(whole, F.col("anchor_id")).otherwise(F.col("end_id")).alias("page_id"))


def select_all(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    return manifest.select(*_KEYS), manifest.groupBy("doc_id").agg(F.min_by("page_id", "position").alias("page_id"))


def clear(selection: DataFrame) -> DataFrame:
    return selection.select(*_KEYS).limit(0)


def collapse_to_single(selection: DataFrame, manifest: DataFrame, preferred: DataFrame, anchors: DataFrame) -> DataFrame:
    """One page of each document's selection: the preferred one, else the anchor, else the first in
    order, else any. Selections of one page stay."""
    chosen = selection.select(*_KEYS).distinct().join(manifest.select(*_KEYS, "position"), _KEYS, "left")
    chosen = chosen.join(preferred.select(*_KEYS, F.lit(0).alias("p")), _KEYS, "left").join(anchors.select(*_KEYS, F.lit(1).alias("q")), _KEYS, "left")
    best = Window.partitionBy("doc_id").orderBy(F.coalesce("p", "q", F.lit(2)), F.asc_nulls_last("position"), "page_id")
    return chosen.withColumn("n", F.row_number().over(best)).filter("n = 1").select(*_KEYS)


def delete_selected(manifest: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest without the selected pages, and the cleared selection."""
    return delete(manifest, selection), clear(selection)


def rotate_selected(manifest: DataFrame, selection: DataFrame, delta: int) -> DataFrame:
    return rotate(manifest, selection, delta)


def selected_count(selection: DataFrame) -> DataFrame:
    return selection.select(*_KEYS).distinct().groupBy("doc_id").agg(F.count("*").alias("n_selected"))


def replay_clicks(manifest: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selection and anchors after a log of clicks (doc_id, seq, kind, page_id), beginning with nothing selected.

    ``single`` and ``range`` replace the selection as ``select_single`` and ``select_range`` do, ``all`` takes every page and
    the first as anchor, ``clear`` none, and ``toggle`` puts a page in or takes it out. Other kinds, and rows without a
    seq, do nothing; a null page is no page; rows of one seq go by kind and page. Only windows and joins: a range needs the
    anchor of its time, which is the last one set, or the first range's own page after one that isn't there; what is
    selected is the last replacing click's set, with the parity of each page's toggles since.
    """
    at = manifest.select("doc_id", "page_id", "position")
    firsts = at.groupBy("doc_id").agg(F.min_by("page_id", "position").alias("first_page"))
    log = clicks.filter("seq IS NOT NULL AND kind IN ('single', 'toggle', 'range', 'all', 'clear')").select("doc_id", "seq", "kind", "page_id").filter("page_id IS NOT NULL OR kind IN ('all', 'clear')")
    log = log.join(firsts, "doc_id", "left").withColumn("value", F.when(F.col("kind") == "all", F.col("first_page")).when(F.col("kind") != "clear", F.col("page_id")))
    log = log.join(at.select("doc_id", F.col("page_id").alias("value"), F.col("position").alias("place")), ["doc_id", "value"], "left")
    # A range to a page that isn't there sets the anchor like a single click; one to a page that is sets it only where none is valid.
    keeps = (F.col("kind") == "range") & F.col("place").isNotNull()
    order = Window.partitionBy("doc_id").orderBy("seq", "kind", F.asc_nulls_first("page_id"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("n", F.row_number().over(order)).withColumn("keeps", keeps).withColumn("part", F.sum((~keeps).cast("int")).over(upto))
    within = Window.partitionBy("doc_id", "part").orderBy("n")
    set_by = F.max(F.when(~F.col("keeps"), F.struct("value", "place"))).over(within)
    first_range = F.first(F.when(F.col("keeps"), F.struct("value", "place")), ignorenulls=True).over(within)
    log = log.withColumn("anchor", F.when(F.col("part") == 0, first_range).when(set_by["place"].isNotNull(), set_by).otherwise(F.coalesce(first_range, set_by)))
    log = log.withColumn("before", F.lag("anchor").over(order))
    last = log.groupBy("doc_id").agg(F.max_by("anchor", "n").alias("anchor"))
    replaced = F.max(F.when(F.col("kind") != "toggle", F.struct("n", "kind", "page_id", "place", F.col("before.place").alias("from"))))
    bases = log.groupBy("doc_id").agg(replaced.alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")
    spans = F.col("kind") == "all", (F.col("kind") == "range") & F.col("place").isNotNull() & F.col("from").isNotNull()
    whole = at.join(bases.filter(spans[0] | spans[1]).select("doc_id", "kind", "place", "from"), "doc_id")
    whole = whole.filter((F.col("kind") == "all") | F.col("position").between(F.least("place", "from"), F.greatest("place", "from"))).select(*_KEYS)
    alone = bases.filter((F.col("kind") == "single") | (F.col("kind") == "range") & ~spans[1]).select(*_KEYS)
    toggles = log.filter("kind = 'toggle'").join(bases.select("doc_id", F.col("n").alias("since")), "doc_id", "left").filter(F.col("n") > F.coalesce("since", F.lit(0))).select(*_KEYS)
    chosen = whole.distinct().unionByName(alone).unionByName(toggles).groupBy(*_KEYS).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*_KEYS)
    return chosen, last.select("doc_id", F.col("anchor.value").alias("page_id")).filter("page_id IS NOT NULL")
