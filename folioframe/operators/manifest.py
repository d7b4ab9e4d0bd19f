"""Page manifests: which source page stands where, and how it is turned.

manifest(doc_id, position from 1, page_id, source_id, source_index from 0, rotation). All operators
work on all documents at once and keep positions dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_rotation, output_name, part_suffix

MANIFEST = ["doc_id", "position", "page_id", "source_id", "source_index", "rotation"]


def _order():
    return Window.partitionBy("doc_id").orderBy("position")


def _upto():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _all():
    return Window.partitionBy("doc_id")


def _dense(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.row_number().over(_order()))


def _into(low: int | Column, value: Column, high: Column) -> Column:
    return F.least(high, F.greatest(F.lit(low) if isinstance(low, int) else low, value))


def initial_pages(sources: DataFrame) -> DataFrame:
    """One row for each page of each source: (doc_id, source_ord, source_id, source_index, page_id, rotation)."""
    pages = sources.filter("num_pages > 0").select("doc_id", "source_ord", "source_id", F.explode(F.sequence(F.lit(0), F.col("num_pages").cast("int") - 1)).alias("source_index"))
    return pages.select("*", F.concat_ws("-", "doc_id", "source_id", "source_index").alias("page_id"), F.lit(0).alias("rotation"))


def merged_manifest(sources: DataFrame) -> DataFrame:
    """All sources of a document one after the other."""
    order = Window.partitionBy("doc_id").orderBy("source_ord", "source_id", "source_index")
    return initial_pages(sources).withColumn("position", F.row_number().over(order)).select(*MANIFEST)


def merged_documents(sources: DataFrame) -> DataFrame:
    """(doc_id, name, size_bytes, num_pages, n_sources): several sources are called merged.pdf."""
    return sources.groupBy("doc_id").agg(
        F.when(F.count("*") > 1, "merged.pdf").otherwise(F.min_by("name", F.struct("source_ord", "source_id"))).alias("name"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum(F.when(F.col("num_pages") > 0, F.col("num_pages")).otherwise(0)).alias("num_pages"),
        F.count("*").alias("n_sources"),
    )


def _flagged(manifest: DataFrame, targets: DataFrame, *more: str) -> DataFrame:
    """The manifest with ``hit`` (boolean) and the targets' further columns."""
    keys = ["doc_id", "page_id"]
    marks = targets.select(*keys, *more, F.lit(True).alias("hit")).dropDuplicates(keys)
    return manifest.join(marks, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def rotate(manifest: DataFrame, targets: DataFrame, delta: int | None = None) -> DataFrame:
    """Turn the pages in ``targets`` (doc_id, page_id, and delta unless given); unknown ids do nothing."""
    found = _flagged(manifest, targets if delta is None else targets.withColumn("delta", F.lit(delta)), "delta")
    return found.withColumn("rotation", F.when(F.col("hit"), normalize_rotation(F.col("rotation") + F.col("delta"))).otherwise(F.col("rotation"))).select(*MANIFEST)


def delete(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    return _dense(manifest.join(targets.select("doc_id", "page_id"), ["doc_id", "page_id"], "left_anti")).select(*MANIFEST)


def reorder(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """Move pages as one block, in the order they have, to a place in what is left.

    ``moves`` is (doc_id, ids array<string>, to_index), one row for a document. The place is counted
    in the list without the moved pages and put into its bounds. One exchange, no self join.
    """
    flags = manifest.join(moves.select("doc_id", "ids", "to_index"), "doc_id", "left")
    m = F.coalesce(F.array_contains("ids", F.col("page_id")), F.lit(False)).cast("int")
    flags = flags.withColumn("m", m).withColumn("k", F.sum("m").over(_upto())).withColumn("moved", F.sum("m").over(_all())).withColumn("n", F.count("*").over(_all()))
    at = _into(0, F.coalesce("to_index", F.lit(0)), F.col("n") - F.col("moved"))
    rest = F.row_number().over(_order()) - F.col("k")
    place = F.when(F.col("m") == 1, at + F.col("k")).when(rest <= at, rest).otherwise(rest + F.col("moved"))
    return flags.withColumn("position", place.cast("int")).select(*MANIFEST)


def insert_pages(manifest: DataFrame, inserts: DataFrame) -> DataFrame:
    """``inserts`` is (doc_id, at_index, pages array<struct<page_id, source_id, source_index, rotation>>)."""
    n = manifest.groupBy("doc_id").agg(F.count("*").alias("n"))
    given = inserts.join(n, "doc_id", "left").withColumn("at", _into(0, F.col("at_index"), F.coalesce("n", F.lit(0)))).withColumn("k", F.size("pages"))
    shifted = manifest.join(given.select("doc_id", "at", "k"), "doc_id", "left")
    shifted = shifted.withColumn("position", (F.col("position") + F.when(F.col("position") > F.col("at"), F.col("k")).otherwise(0)).cast("int"))
    new = given.select("doc_id", "at", F.posexplode("pages").alias("i", "p"))
    new = new.select("doc_id", (F.col("at") + F.col("i") + 1).cast("int").alias("position"), "p.page_id", "p.source_id", "p.source_index", "p.rotation")
    return shifted.select(*MANIFEST).unionByName(new)


def extract(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """The pages in ``targets``, in their present order."""
    return _dense(manifest.join(targets.select("doc_id", "page_id"), ["doc_id", "page_id"], "left_semi")).select(*MANIFEST)


def without_pages(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents that have no page: extracting or building them is an error."""
    return documents.select("doc_id").join(manifest.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no pages"))


def split(manifest: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Cut before the pages in ``boundaries`` (doc_id, boundary): adds part_no and part_position from 1.

    A boundary counts if it is above 1 and at most the number of pages; then its fraction is dropped,
    so that 1.5 cuts before page 1 and makes no part.
    """
    n = manifest.groupBy("doc_id").agg(F.count("*").alias("n"))
    cuts = boundaries.join(n, "doc_id").filter("boundary > 1 AND boundary <= n").select("doc_id", F.col("boundary").cast("int").alias("position"), F.lit(1).alias("cut")).distinct()
    parts = manifest.join(cuts.filter("position > 1"), ["doc_id", "position"], "left")
    parts = parts.withColumn("part_no", (1 + F.sum(F.coalesce("cut", F.lit(0))).over(_upto())).cast("int"))
    return parts.withColumn("part_position", F.row_number().over(Window.partitionBy("doc_id", "part_no").orderBy("position"))).select(*MANIFEST, "part_no", "part_position")


def part_names(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, part_no, n_pages, part_name): the document's name with -01, -02, ..."""
    counts = parts.groupBy("doc_id", "part_no").agg(F.count("*").alias("n_pages")).join(documents.select("doc_id", "name"), "doc_id", "left")
    return counts.select("doc_id", "part_no", "n_pages", output_name(F.col("name"), part_suffix(F.col("part_no"))).alias("part_name"))


def boundaries_from_selection(selection: DataFrame, manifest: DataFrame) -> DataFrame:
    return selection.select("doc_id", "page_id").join(manifest, ["doc_id", "page_id"]).filter("position > 1").select("doc_id", F.col("position").alias("boundary")).distinct()


def array_move(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Items (doc_id, position from 1, ...) after taking one out and putting it back elsewhere.

    ``moves`` is (doc_id, from_index, to_index), both from 0; a move out of range changes nothing.
    """
    n = F.count("*").over(_all())
    both = items.join(moves.select("doc_id", "from_index", "to_index"), "doc_id", "left")
    fits = F.coalesce(F.col("from_index").between(0, n - 1) & F.col("to_index").between(0, n - 1), F.lit(False))
    i, a, b = F.col("position") - 1, F.col("from_index"), F.col("to_index")
    to = F.when(i == a, b).when((a < b) & i.between(a + 1, b), i - 1).when((a > b) & i.between(b, a - 1), i + 1).otherwise(i)
    return both.withColumn("position", F.when(fits, to + 1).otherwise(F.col("position")).cast("int")).drop("from_index", "to_index")


def source_order(manifest: DataFrame) -> DataFrame:
    """(doc_id, source_id, source_rank from 1): sources by their first page."""
    first = manifest.groupBy("doc_id", "source_id").agg(F.min("position").alias("first_position"))
    return first.withColumn("source_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_position"))).select("doc_id", "source_id", "first_position", "source_rank")


def doc_key(manifest: DataFrame) -> DataFrame:
    """(doc_id, doc_key): the sources by first appearance, joined by bars."""
    first = manifest.groupBy("doc_id", "source_id").agg(F.min("position").alias("p"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "source_id"))), lambda x: x["source_id"]), "|").alias("doc_key"))


def locate(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, source_id, source_index, ...) with the first position that shows it, or null."""
    first = manifest.groupBy("doc_id", "source_id", "source_index").agg(F.min("position").alias("position"))
    return wanted.join(first, ["doc_id", "source_id", "source_index"], "left")


def check_limits(sources: DataFrame, most_pages: int = 500, most_bytes: int = 50 * 1024**2) -> DataFrame:
    """Totals of each document and whether they are above what is advised."""
    totals = sources.groupBy("doc_id").agg(F.sum("num_pages").alias("num_pages"), F.sum("size_bytes").alias("size_bytes"))
    pages, size = F.col("num_pages") > most_pages, F.col("size_bytes") > most_bytes
    return totals.select("*", pages.alias("pages_exceeded"), size.alias("bytes_exceeded"), (pages | size).alias("exceeded"))


def output_manifest(manifest: DataFrame, page_dims: DataFrame) -> DataFrame:
    """(doc_id, output_index from 0, page_id, source_id, source_index, rotation): as it will be written.

    The page's own turn and the manifest's add up; a page that wasn't measured has none of its own. Every page
    of a source that is there is in it; ``output_errors`` and ``page_errors`` list what can't be written, and the
    pages of missing sources.
    """
    dims = page_dims.select("source_id", "source_index", "page_rotate").dropDuplicates(["source_id", "source_index"])
    joined = manifest.join(page_dims.select("source_id").distinct(), "source_id", "left_semi").join(dims, ["source_id", "source_index"], "left")
    return joined.select("doc_id", (F.col("position") - 1).alias("output_index"), "page_id", "source_id", "source_index", normalize_rotation(F.coalesce("page_rotate", F.lit(0)) + F.col("rotation")).alias("rotation"))


def page_errors(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, position, page_id, source_id, source_index, error) of every page that isn't in its source, from the
    sources' lengths (source_id, num_pages): the source is missing, or the page lies before its first or
    behind its last page. A source that is listed more than once has its greatest length; a null length is 0."""
    lengths = sources.groupBy("source_id").agg(F.coalesce(F.max("num_pages"), F.lit(0)).alias("num_pages"), F.lit(True).alias("known"))
    rows = manifest.join(lengths, "source_id", "left")
    outside = F.coalesce((F.col("source_index") < 0) | (F.col("source_index") >= F.col("num_pages")), F.lit(True))
    page = F.coalesce(F.col("source_index").cast("string"), F.lit("null"))
    error = F.when(F.col("known").isNull(), F.concat(F.lit("missing source "), F.coalesce("source_id", F.lit("null")))).when(
        outside, F.concat(F.lit("page "), page, F.lit(" of source "), F.col("source_id"), F.lit(" with "), F.col("num_pages").cast("string"), F.lit(" pages"))
    )
    return rows.withColumn("error", error).filter("error IS NOT NULL").select("doc_id", "position", "page_id", "source_id", "source_index", "error")


def output_errors(documents: DataFrame, manifest: DataFrame, page_dims: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(doc_id, error) of documents without pages, with a source that isn't there or, given the ``sources``' lengths
    (source_id, num_pages), with pages that their sources don't have."""
    missing = manifest.join(page_dims.select("source_id").distinct(), "source_id", "left_anti").select("doc_id", F.concat(F.lit("missing source "), "source_id").alias("error")).distinct()
    if sources is not None:
        missing = page_errors(manifest, sources).select("doc_id", "error").distinct()
    return without_pages(documents, manifest).unionByName(missing)


def page_geometry(manifest: DataFrame, page_dims: DataFrame) -> DataFrame:
    """(doc_id, position, total_rotation, width, height) as shown: a quarter turn swaps the sides, and a
    page that wasn't measured takes the first page's size."""
    dims = page_dims.select("source_id", "source_index", "width", "height", "page_rotate").dropDuplicates(["source_id", "source_index"])
    joined = manifest.join(dims, ["source_id", "source_index"], "left")
    whole = _order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width, height = F.coalesce("width", F.first("width").over(whole)), F.coalesce("height", F.first("height").over(whole))
    sized = joined.select("doc_id", "position", "rotation", F.pmod(F.coalesce("page_rotate", F.lit(0)) + F.col("rotation"), F.lit(360)).alias("total_rotation"), width.alias("w"), height.alias("h"))
    turned = F.pmod(F.col("total_rotation"), F.lit(180)) == 90
    return sized.select("doc_id", "position", "total_rotation", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("width"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("height"))
