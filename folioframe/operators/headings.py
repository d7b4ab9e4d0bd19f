"""Headings of page lines: reconstruction, patterns, sequence filter, hierarchy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.regex import group_number, is_blank, is_valid, widen
from ..functions.scalars import is_toc_leader, leading_numbers, normalize_title

#: The built-in heading patterns.
DEFAULT_PATTERNS = [
    {"id": "builtin-chapter", "label": "章（第N章）", "level": 1, "enabled": True, "builtin": True,
     "pattern": r"^\s*(?<title>第[0-9\uff10-\uff19]+章(?:\s+\S.*)?)\s*$"},
    {"id": "builtin-section", "label": "節（N.N）", "level": 2, "enabled": True, "builtin": True,
     "pattern": r"^\s*(?<title>[0-9\uff10-\uff19]+\.[0-9\uff10-\uff19]+(?!\.[0-9\uff10-\uff19])(?=.*[A-Za-z\u3040-\u30ff\u4e00-\u9fff])\s+.*\S)\s*$"},
    {"id": "builtin-item", "label": "項（N.N.N）", "level": 3, "enabled": True, "builtin": True,
     "pattern": r"^\s*(?<title>[0-9\uff10-\uff19]+\.[0-9\uff10-\uff19]+\.[0-9\uff10-\uff19]+(?=.*[A-Za-z\u3040-\u30ff\u4e00-\u9fff])\s+.*\S)\s*$"},
]


#: A document is scanned in blocks of this many pages, each in one window; what a block passes on is a row.
PAGES_PER_BLOCK = 64


def _blocks(rows: DataFrame, pages: int) -> DataFrame:
    # One value, so that an unknown document or page is a key like any other.
    return durable(rows.withColumn("__block", F.struct("doc_id", F.floor(F.col("page_number") / pages).alias("n"))))


def _before():
    """The lines of the same block before this one."""
    return Window.partitionBy("__block").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, -1)


def _blocks_before(*more: str):
    """The blocks of the document before this one."""
    return Window.partitionBy("__block.doc_id", *more).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def compile_patterns(spark: SparkSession, patterns: list[dict]) -> list[tuple[str, int, int]]:
    """(pattern, group of the title, level) of the enabled, valid ones, deepest level first."""
    out = []
    for p in sorted((p for p in patterns if p["enabled"]), key=lambda p: -p["level"]):
        pattern = "(?m)" + widen(p["pattern"])
        if is_valid(spark, pattern):
            out.append((pattern, group_number(p["pattern"], "title") or 0, p["level"]))
    return out


def merge_patterns(stored: list[dict] | None, defaults: list[dict] = DEFAULT_PATTERNS) -> list[dict]:
    """The defaults with the stored switches, and the stored custom patterns behind them.

    Malformed rows don't count; of repeated built-in ids the last one does."""
    if not isinstance(stored, list):
        return [dict(p) for p in defaults]
    good = [p for p in stored if isinstance(p, dict) and isinstance(p.get("id"), str) and isinstance(p.get("pattern"), str) and p.get("level") in (1, 2, 3)]
    switches = {p["id"]: bool(p.get("enabled")) for p in good if p.get("builtin")}
    known = {p["id"] for p in defaults}
    custom = [p | {"builtin": False} for p in good if not p.get("builtin") and p["id"] not in known]
    return [p | {"enabled": switches.get(p["id"], p["enabled"])} for p in defaults] + custom


def match_heading(line: Column, compiled: list[tuple[str, int, int]], title: Callable[[Column], Column] = normalize_title) -> Column:
    """struct<level, title> by the first pattern that gives a title, or null. ``title`` says how a title should read."""
    if not compiled:
        return F.lit(None).cast("struct<level:int,title:string>")
    tries = []
    for pattern, group, level in compiled:
        # An array of one, so that a title is worked out once, and only where its pattern is the first to fit.
        titled = F.array(F.struct(F.lit(level).alias("level"), title(F.regexp_extract(line, pattern, group)).alias("title")))
        tries.append(F.when(line.rlike(pattern), F.get(F.filter(titled, lambda x: F.length(x["title"]) > 0), 0)))
    return F.when(~is_blank(line) & ~is_toc_leader(line), F.coalesce(*tries))


def find_headings(lines: DataFrame, compiled: list[tuple[str, int, int]], title: Callable[[Column], Column] = normalize_title) -> DataFrame:
    """(doc_id, page_number, line_no, level, title, seq) of lines (doc_id, page_number, line_no, line).

    Titles of numbered headings by default; ``scalars.plain_title`` leaves numbers as they stand."""
    found = lines.withColumn("h", match_heading(F.col("line"), compiled, title)).filter("h IS NOT NULL")
    return found.select("doc_id", "page_number", "line_no", "h.level", "h.title").withColumn("seq", leading_numbers(F.col("title")))


def sequence_filter(headings: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Headings with ``accepted``: a number below the last one accepted at its level is out.

    An accepted number starts the deeper levels anew; headings without a number are always in and
    start nothing. Level by level: since the last accepted heading of a higher level, the last accepted number is
    the largest so far. That is a running maximum in stretches, taken in blocks of pages: a block passes on how many
    stretches it begins and the largest number of its last one, a document's blocks combine these, and each block goes
    on from what came before it. So one document's headings lie in many tasks; only its blocks' rows, one for
    ``pages_per_block`` pages, meet in one. Rows are checkpointed when this is called, so that no pattern is tried twice.
    """
    out = _blocks(headings.withColumn("accepted", F.lit(True)), pages_per_block)
    for level in (1, 2, 3):
        here = (F.col("level") == level) & F.col("seq").isNotNull()
        begins = F.when((F.col("level") < level) & F.col("seq").isNotNull() & F.col("accepted"), 1).otherwise(0)
        out = out.withColumn("__begins", begins).withColumn("__stretch", F.coalesce(F.sum("__begins").over(_before()), F.lit(0)))
        out = out.withColumn("__best", F.when(here, F.struct(F.col("__stretch").alias("at"), F.col("seq").alias("seq"))))
        ends = out.groupBy("__block").agg(F.sum("__begins").alias("begun"), F.max("__best").alias("best"))
        before = F.coalesce(F.sum("begun").over(_blocks_before()), F.lit(0))
        ends = ends.withColumn("before", before).withColumn("last", F.when(F.col("best.at") == F.col("begun"), F.struct((F.col("before") + F.col("begun")).alias("at"), F.col("best.seq").alias("seq"))))
        ends = ends.withColumn("given", F.max("last").over(_blocks_before())).filter(F.col("given.at") == F.col("before"))
        out = out.join(ends.select("__block", F.col("given.seq").alias("__given")), "__block", "left")
        top = F.max("__best").over(_before())
        top = F.greatest(F.when(top["at"] == F.col("__stretch"), top["seq"]), F.when(F.col("__stretch") == 0, F.col("__given")))
        out = out.withColumn("__top", top).withColumn("accepted", F.when(here, F.col("__top").isNull() | (F.col("seq") >= F.col("__top"))).otherwise(F.col("accepted")))
        out = out.drop("__begins", "__stretch", "__best", "__given", "__top")
        if level < 3:
            out = durable(out)
    return out.select(*headings.columns, *(["accepted"] if "accepted" not in headings.columns else []))


def detect_headings(lines: DataFrame, compiled: list[tuple[str, int, int]]) -> DataFrame:
    return sequence_filter(find_headings(lines, compiled)).filter("accepted").drop("accepted")


def median_font(items: DataFrame) -> DataFrame:
    """(source_id, source_index, median): of the sizes above 0 the upper median, 0 if there are none."""
    sizes = F.array_sort(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))))
    rows = items.groupBy("source_id", "source_index").agg(sizes.alias("sizes"))
    return rows.select("source_id", "source_index", F.coalesce(F.expr("get(sizes, CAST(floor(size(sizes) / 2) AS INT))"), F.lit(0.0)).alias("median"))


def reconstruct_lines(items: DataFrame, ratio: float = 0.3, least: float = 2.0) -> DataFrame:
    """(source_id, source_index, line_no, line) from placed text items, top to bottom.

    An item belongs to a line if its y is within the tolerance of the line's first item; within a line
    items go by x. Ties keep item order. One fold for each page inside the JVM; pages go in parallel.
    Items that lie together already, an array for each page, go to ``lines_of_pages`` without a shuffle.
    """
    item = F.struct(*(F.col(c) for c in _ITEM))
    return lines_of_pages(items.groupBy("source_id", "source_index").agg(F.collect_list(item).alias("items")), ratio, least)


_ITEM = ("item_no", "str", "x", "y", "font_size")


def lines_of_pages(pages: DataFrame, ratio: float = 0.3, least: float = 2.0) -> DataFrame:
    """As ``reconstruct_lines``, of pages (source_id, source_index, items: array of structs of item_no, str, x, y, font_size),
    one row each."""
    placed = F.transform("items", lambda z: F.struct((-z["y"]).alias("down"), z["item_no"], z["x"], z["str"]))
    sizes = F.array_sort(F.transform(F.filter("items", lambda z: z["font_size"] > 0), lambda z: z["font_size"]))
    pages = pages.select("source_id", "source_index", F.array_sort(placed).alias("items"), sizes.alias("sizes"))
    pages = pages.withColumn("tol", F.expr(f"greatest({float(least)}D, {float(ratio)}D * coalesce(get(sizes, CAST(floor(size(sizes) / 2) AS INT)), 0D))"))
    starts = F.expr(
        "aggregate(items, named_struct('anchor', CAST(NULL AS DOUBLE), 'i', 1, 'out', CAST(array() AS ARRAY<INT>)), (s, x) -> IF(abs(x.down - s.anchor) <= tol, "
        "named_struct('anchor', s.anchor, 'i', s.i + 1, 'out', s.out), named_struct('anchor', x.down, 'i', s.i + 1, 'out', concat(s.out, array(s.i)))), s -> s.out)"
    )
    lines = F.expr(
        "transform(starts, (a, k) -> array_join(transform(array_sort(transform("
        "slice(items, a, coalesce(get(starts, k + 1), size(items) + 1) - a), (x, rank) -> struct(x.x, rank, x.str))), z -> z.str), ''))"
    )
    rows = pages.withColumn("starts", starts).select("source_id", "source_index", F.posexplode(lines).alias("n", "line"))
    return rows.select("source_id", "source_index", (F.col("n") + 1).alias("line_no"), "line")


def page_lines(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, line) for each displayed page."""
    return manifest.join(lines, ["source_id", "source_index"]).select("doc_id", F.col("position").alias("page_number"), "line_no", "line")


def build_hierarchy(headings: DataFrame, manifest: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Outline rows (doc_id, node_id, parent_id, sib_index, title, source_id, source_index) of headings.

    A heading's parent is the nearest one before it with a smaller level; levels may be missing.
    Headings on pages that the manifest doesn't have go first. Blocks of pages pass on their latest headings and how many
    children each parent got, as in ``sequence_filter``; rows are checkpointed when this is called.
    """
    pages = manifest.select("doc_id", F.col("position").alias("page_number"), "source_id", "source_index")
    rows = headings.join(pages, ["doc_id", "page_number"]).withColumn("node_id", F.concat_ws("-", "doc_id", "page_number", "line_no"))
    rows = _blocks(rows, pages_per_block)
    above = {level: F.when(F.col("level") < level, F.col("node_id")) for level in (2, 3)}
    order = F.struct("page_number", "line_no")
    ends = rows.groupBy("__block").agg(*(F.max_by(F.col("node_id"), F.when(F.col("level") < level, order)).alias(f"last{level}") for level in above))
    given = [F.last(f"last{level}", ignorenulls=True).over(_blocks_before()).alias(f"__given{level}") for level in above]
    rows = rows.join(ends.select("__block", *given), "__block")
    latest = [F.when(F.col("level") == level, F.coalesce(F.last(c, ignorenulls=True).over(_before()), F.col(f"__given{level}"))) for level, c in above.items()]
    rows = durable(rows.withColumn("parent_id", F.coalesce(*latest)).drop("__given2", "__given3"))
    # Roots have a parent too here: none.
    rows = rows.withColumn("__of", F.struct("parent_id"))
    children = rows.groupBy("__block", "__of").agg(F.count("*").alias("n"))
    rows = rows.join(children.select("__block", "__of", F.sum("n").over(_blocks_before("__of")).alias("__older")), ["__block", "__of"])
    place = F.row_number().over(Window.partitionBy("__block", "__of").orderBy("page_number", "line_no")) - 1 + F.coalesce("__older", F.lit(0))
    return rows.withColumn("sib_index", place).select("doc_id", "node_id", "parent_id", F.col("sib_index").cast("int").alias("sib_index"), "title", "source_id", "source_index")


def auto_outline(manifest: DataFrame, items: DataFrame, compiled: list[tuple[str, int, int]], start_page: int = 1) -> DataFrame:
    """The outline of the headings on the displayed pages from ``start_page`` on. ``items`` are rows as for
    ``reconstruct_lines``, or pages as for ``lines_of_pages``. Only lines that a pattern fits meet the manifest."""
    lines = lines_of_pages(items) if "items" in items.columns else reconstruct_lines(items)
    fit = lines.filter(match_heading(F.col("line"), compiled).isNotNull())
    found = find_headings(page_lines(fit, manifest.filter(F.col("position") >= start_page)), compiled)
    return build_hierarchy(sequence_filter(found).filter("accepted").drop("accepted"), manifest)


def apply_outline(existing: DataFrame, generated: DataFrame, mode: str) -> DataFrame:
    """``replace``, or ``append`` the generated roots behind the existing ones."""
    if mode == "replace":
        return generated
    columns = ["doc_id", "node_id", "parent_id", "sib_index", "title", "source_id", "source_index"]
    last = existing.filter("parent_id IS NULL").groupBy("doc_id").agg((F.max("sib_index") + 1).alias("offset"))
    moved = generated.join(last, "doc_id", "left").withColumn("sib_index", F.col("sib_index") + F.when(F.col("parent_id").isNull(), F.coalesce("offset", F.lit(0))).otherwise(0))
    return existing.select(*columns).unionByName(moved.select(*columns))


def apply_outlines(existing: DataFrame, generated: DataFrame, modes: DataFrame) -> DataFrame:
    """As ``apply_outline``, for each document by its own row of ``modes`` (doc_id, mode: replace or append), in one job.

    A document without a mode keeps its outline, and what was generated for it goes; one to be replaced for which nothing
    was generated ends without an outline. Of several rows of a document ``replace`` counts.
    """
    modes = modes.filter(F.col("mode").isin("replace", "append")).groupBy("doc_id").agg(F.max("mode").alias("mode"))
    replaced, wanted = modes.filter("mode = 'replace'"), modes.select("doc_id")
    return apply_outline(existing.join(replaced, "doc_id", "left_anti"), generated.join(wanted, "doc_id", "left_semi"), "append")


def detection_profile(manifest: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, current_page, total_pages, found_count): headings found up to each page."""
    per = headings.groupBy("doc_id", F.col("page_number").alias("position")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("position")
    rows = manifest.select("doc_id", "position").join(per, ["doc_id", "position"], "left")
    found = F.sum(F.coalesce("n", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("doc_id", F.col("position").alias("current_page"), F.count("*").over(Window.partitionBy("doc_id")).alias("total_pages"), found.alias("found_count"))
