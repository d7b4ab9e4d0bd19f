"""Reading and checking sources, text items and settings; writing results."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_pdf, maybe_encrypted, output_name, pdf_version, text_or_null
from .commits import load, save_version, saved_folder
from .pieces import headers, token_pieces


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of files; their bytes aren't read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def triage(spark: SparkSession, path: str, piece: int = 16 << 20, pieces_per_task: int = 16) -> DataFrame:
    """(path, length, version, maybe_encrypted) by the files' bytes, as ``triage_content`` gives them.

    Files are read in pieces of ``piece`` bytes, each with as many bytes of the next as a token needs, so a file of
    any size is spread over tasks and never one value; a token or a header over a border is found. Empty files
    are not listed. How many bytes there are is counted when this is called, from the listing alone. Executors must reach the
    files by their path.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / piece)
    tasks = files.agg(F.sum(last + 1)).first()[0] or 1
    pieces = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("n"))
    # A fixed number of partitions, since the rows are tiny and would be merged by their size.
    spread = pieces.repartition(max(1, min(-(-tasks // pieces_per_task), 100_000)), "path", "n")
    found = spread.mapInPandas(token_pieces(piece), "path string, length long, encrypted boolean, header_at long")
    of_file = found.groupBy("path").agg(F.max("length").alias("length"), F.max("encrypted").alias("maybe_encrypted"), F.min("header_at").alias("header_at"))
    # An exchange by file came before, so files are spread here too.
    return of_file.mapInPandas(headers(), "path string, length long, version string, maybe_encrypted boolean")


def triage_content(files: DataFrame) -> DataFrame:
    """Files with a column ``content`` (binary), and what their bytes say: version and maybe_encrypted."""
    return files.withColumn("version", pdf_version(F.col("content"))).withColumn("maybe_encrypted", maybe_encrypted(F.col("content")))


def intake(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (doc_id, name, mime, ...) that are accepted, and (doc_id, accepted_count, rejected_count)."""
    flagged = files.withColumn("accepted", is_pdf(F.col("name"), F.col("mime")))
    counts = flagged.groupBy("doc_id").agg(F.count_if("accepted").alias("accepted_count"), F.count_if(~F.col("accepted")).alias("rejected_count"))
    return flagged.filter("accepted").drop("accepted"), counts


def with_state(sources: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Sources with num_pages and state: ready with a count, error without one."""
    joined = sources.drop("num_pages", "state").join(page_counts.select("source_id", "num_pages"), "source_id", "left")
    return joined.withColumn("state", F.when(F.col("num_pages").isNotNull(), "ready").otherwise("error"))


def can_merge(sources: DataFrame) -> DataFrame:
    """(doc_id, can_merge): two sources or more and none that failed; one still loading is no hindrance."""
    failed = F.coalesce(F.bool_or(F.col("state") == "error"), F.lit(False))
    return sources.groupBy("doc_id").agg(((F.count("*") >= 2) & ~failed).alias("can_merge"))


def doc_meta(sources: DataFrame) -> DataFrame:
    return sources.select("doc_id", "source_id", "num_pages", text_or_null(F.col("title")).alias("title"), text_or_null(F.col("author")).alias("author"))


def text_items(raw: DataFrame) -> DataFrame:
    """(source_id, source_index, item_no, str, x, y, font_size) of raw items; malformed ones go."""
    t = F.col("transform")
    good = raw.filter((F.length("str") > 0) & (F.size("transform") >= 6))
    size = F.when(F.col("height") > 0, F.col("height")).otherwise(F.abs(F.get(t, 3)))
    return good.select("source_id", "source_index", "item_no", "str", F.get(t, 4).alias("x"), F.get(t, 5).alias("y"), size.alias("font_size"))


def page_text(items: DataFrame) -> DataFrame:
    """One text for each source page: its items in item order, with nothing between."""
    parts = F.array_sort(F.collect_list(F.struct("item_no", F.coalesce("str", F.lit("")).alias("s"))))
    return items.groupBy("source_id", "source_index").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))


def displayed_text(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page, text) for each displayed page; a page without text has an empty one."""
    joined = manifest.join(texts.select("source_id", "source_index", "text"), ["source_id", "source_index"], "left")
    return joined.select("doc_id", F.col("position").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """As Parquet, to be read by ``load``; an existing target is an error unless it is to be overwritten. The target
    changes in one step (``commits.py``)."""
    save_version(df.sparkSession, path, overwrite, df.write.parquet)


def save_split(parts: DataFrame, path: str, overwrite: bool = False, buckets: int = 64) -> None:
    """Parts (doc_id, part_no, ...) in ``buckets`` folders: all parts of a document in one, in files sorted by
    document, part and place, so that reading a document or a part skips the rest."""
    rows = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    rows = rows.repartition("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id", "part_no", *(["part_position"] if "part_position" in parts.columns else []))
    save_version(parts.sparkSession, path, overwrite, rows.write.partitionBy("bucket").parquet)


def load_split(spark: SparkSession, path: str, doc_id=None, part_no: int | None = None, buckets: int = 64) -> DataFrame:
    """What ``save_split`` wrote: all of it, a document, or one of its parts."""
    rows = load(spark, path)
    if doc_id is not None:
        wanted = F.lit(doc_id).cast(rows.schema["doc_id"].dataType)
        rows = rows.filter((F.col("bucket") == F.pmod(F.xxhash64(wanted), F.lit(buckets))) & (F.col("doc_id") == wanted))
    return (rows if part_no is None else rows.filter(F.col("part_no") == part_no)).drop("bucket")


def save_extract(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Extracted pages; a column file_name gets the ending of extracts. Nothing to save is an error."""
    if df.isEmpty():
        raise ValueError("nothing is selected")
    save(df.withColumn("file_name", output_name(F.col("file_name"), F.lit("-extract"))) if "file_name" in df.columns else df, path, overwrite)


PATTERN_SCHEMA = "id string, label string, pattern string, level int, enabled boolean, builtin boolean"


def load_patterns(spark: SparkSession, path: str) -> list[dict] | None:
    """The stored patterns, a few rows of JSON; None if they can't be read."""
    try:
        rows = spark.read.schema("ord int, " + PATTERN_SCHEMA).json(saved_folder(spark, path)).orderBy("ord").drop("ord").collect()
    except PySparkException:
        return None
    return [r.asDict() for r in rows]


def save_patterns(spark: SparkSession, patterns: list[dict], path: str) -> None:
    rows = [(i, *(p.get(k) for k in ("id", "label", "pattern", "level", "enabled", "builtin"))) for i, p in enumerate(patterns)]
    save_version(spark, path, True, spark.createDataFrame(rows, "ord int, " + PATTERN_SCHEMA).coalesce(1).write.json)

