"""Text search with offsets in code points, hit navigation and highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import build_matcher

_NO_HITS = "array<struct<start:int,end:int>>"


def _turns(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: the pieces between the leftmost matches and the matches take turns."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # An empty match at the very start has no piece before it.
    pieces = F.when(F.size(between) == F.size(found), F.concat(F.array(F.lit("")), between)).otherwise(between)
    return F.arrays_zip(pieces.alias("gap"), found.alias("hit"))


def _running(numbers: Column) -> Column:
    """The running sums of array<int>, in about log2(n) passes over it: each adds what stands twice as far back."""

    def add(sums: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        further = F.transform(sums, lambda x, i: x + F.when(i >= far, F.coalesce(F.get(sums, i - far), F.lit(0))).otherwise(0))
        return F.when(far >= F.size(sums), sums).otherwise(further)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), numbers, add)


def hit_spans(text: Column, pattern: str | None) -> Column:
    """array<struct<start, end>> of the leftmost matches that don't overlap; empty ones don't count."""
    if pattern is None:
        return F.array().cast(_NO_HITS)
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    sizes = F.transform(_turns(text, pattern), lambda t: F.struct(size(t["hit"]).alias("hit"), (size(t["gap"]) + size(t["hit"])).alias("both")))
    # An array of one, so that the sizes are worked out once.
    spans = F.transform(F.array(sizes), lambda z: F.zip_with(z, _running(F.transform(z, lambda x: x["both"])), lambda x, end: F.struct((end - x["hit"]).alias("start"), end.alias("end"))))
    spans = F.filter(F.get(spans, 0), lambda s: s["end"] > s["start"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_NO_HITS)).cast(_NO_HITS)


def find_matches(pages: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, page, start, end) of pages (doc_id, page, text). A narrow step: nothing is shuffled."""
    pattern = build_matcher(pages.sparkSession, query, regex, case_sensitive)
    hits = pages.filter("text IS NOT NULL").select("doc_id", "page", F.explode(hit_spans(F.col("text"), pattern)).alias("h"))
    return hits.select("doc_id", "page", "h.start", "h.end")


def count_hits(pages: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, hits) for each document, 0 where nothing is found."""
    pattern = build_matcher(pages.sparkSession, query, regex, case_sensitive)
    if pattern is None:
        n = F.lit(0)
    elif regex:
        n = F.size(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.length(x) > 0))
    else:
        n = F.regexp_count("text", F.lit(pattern))
    return pages.groupBy("doc_id").agg(F.sum(F.coalesce(n, F.lit(0))).cast("bigint").alias("hits"))


def top_documents(counts: DataFrame, k: int) -> DataFrame:
    return counts.filter("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(k)


def with_navigation(hits: DataFrame) -> DataFrame:
    """hit_no from 0 in each document, the numbers before and after it in a ring, and next_page."""
    order = Window.partitionBy("doc_id").orderBy("page", "start")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = hits.withColumn("hit_no", F.row_number().over(order) - 1).withColumn("n_hits", n)
    ring = lambda step: F.pmod(F.col("hit_no") + step + F.col("n_hits"), F.col("n_hits")).cast("int")
    return numbered.select("*", ring(1).alias("next_hit"), ring(-1).alias("prev_hit"), F.coalesce(F.lead("page").over(order), F.first("page").over(whole)).alias("next_page"))


def active_hit(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, active_hit): the first one, or -1 where there is none."""
    found = hits.select("doc_id").distinct().withColumn("active_hit", F.lit(0))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("active_hit", F.lit(-1)).alias("active_hit"))


def local_ordinals(hits: DataFrame) -> DataFrame:
    return hits.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("start")) - 1)


def highlight(items: DataFrame, query: str, current: Column | int | None = None, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Items (doc_id, page, item_no, str) with ``marked``: hits inside an item in mark elements.

    Hits count on through a page's items; the one numbered ``current`` (from 0, a column or a number)
    says so. Escaping for HTML is the caller's; marking always starts from ``str``, so it can be
    repeated.
    """
    pattern = build_matcher(items.sparkSession, query, regex, case_sensitive)
    if pattern is None:
        return items.withColumn("marked", F.col("str"))
    is_hit = lambda t: (F.coalesce(F.length(t["hit"]), F.lit(0)) > 0).cast("int")
    turns = items.withColumn("__turns", F.coalesce(_turns(F.col("str"), pattern), F.array().cast("array<struct<gap:string,hit:string>>")))
    turns = turns.withColumn("__upto", _running(F.transform("__turns", is_hit)))
    before = Window.partitionBy("doc_id", "page").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    hits = F.coalesce(F.try_element_at("__upto", F.lit(-1)), F.lit(0))
    turns = turns.withColumn("__base", F.coalesce(F.sum(hits).over(before), F.lit(0))).withColumn("__current", F.lit(current) if current is None or isinstance(current, int) else current)

    def mark(turn: Column, upto: Column) -> Column:
        now = F.coalesce(F.col("__base") + upto - 1 == F.col("__current"), F.lit(False))
        tag = F.when(now, '<mark class="search-hit" data-current="true">').otherwise('<mark class="search-hit">')
        return F.concat(turn["gap"], F.when(is_hit(turn) == 1, F.concat(tag, turn["hit"], F.lit("</mark>"))).otherwise(""))

    marked = F.when(F.col("str").isNotNull(), F.array_join(F.zip_with("__turns", "__upto", mark), ""))
    return turns.withColumn("marked", marked).drop("__turns", "__upto", "__base", "__current")


def span_gap(page_hits: DataFrame, item_hits: DataFrame) -> DataFrame:
    """(doc_id, page, page_hits, item_hits, missed): hits of a page's text that no single item holds."""
    a = page_hits.groupBy("doc_id", "page").agg(F.count("*").alias("page_hits"))
    b = item_hits.groupBy("doc_id", "page").agg(F.count("*").alias("item_hits"))
    both = a.join(b, ["doc_id", "page"], "left").withColumn("item_hits", F.coalesce("item_hits", F.lit(0)))
    return both.withColumn("missed", F.col("page_hits") - F.col("item_hits"))


def _item_texts(items: DataFrame) -> DataFrame:
    """Items that hold text, numbered in their page from 0 (``k``), with where they begin in its text."""
    order = Window.partitionBy("doc_id", "page").orderBy("item_no")
    held = items.filter(F.length("str") > 0).select("doc_id", "page", "item_no", "str")
    before = F.sum(F.length("str")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return held.select("*", (F.row_number().over(order) - 1).alias("k"), F.coalesce(before, F.lit(0)).cast("int").alias("at"))


def item_spans(items: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, page, start, end, first_item, last_item, crosses): the hits of a page's whole text, which is its items
    (doc_id, page, item_no, str) one after the other, and the items in which each begins and ends.

    Items begin at running sums of lengths; their starts and the ends of hits are merged in order, so a page may have any
    number of either. Null and empty items hold nothing; rows of one item_no stand in any order.
    """
    held = _item_texts(items)
    texts = held.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "str"))), lambda x: x["str"]), "").alias("text"))
    hits = find_matches(texts, query, regex, case_sensitive)
    none = lambda c, kind="int": F.lit(None).cast(kind).alias(c)
    item_type = items.schema["item_no"].dataType
    starts = held.select("doc_id", "page", "at", F.lit(0).alias("side"), "item_no", "k", none("start"), none("end"))
    ends = hits.select("doc_id", "page", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("side")), F.struct((F.col("end") - 1).alias("at"), F.lit(2).alias("side")))), none("item_no", item_type), none("k"), "start", "end")
    upto = Window.partitionBy("doc_id", "page").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = starts.unionByName(ends).withColumn("holds", F.last(F.when(F.col("side") == 0, F.struct("item_no", "k")), ignorenulls=True).over(upto)).filter("side > 0")
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("holds")))
    both = merged.groupBy("doc_id", "page", "start", "end").agg(side(1).alias("a"), side(2).alias("b"))
    return both.select("doc_id", "page", "start", "end", F.col("a.item_no").alias("first_item"), F.col("b.item_no").alias("last_item"), (F.col("a.k") != F.col("b.k")).alias("crosses"))


def crossing_hits(items: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """The hits that no single item holds: ``highlight`` can't mark them, ``highlight_across`` does."""
    return item_spans(items, query, regex, case_sensitive).filter("crosses").drop("crosses")


def highlight_across(items: DataFrame, query: str, current: int | None = None, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Items (doc_id, page, item_no, marked) in which every hit of the page's text is marked, in parts where it goes over
    the borders of items. Hits count on through a page; all parts of the one numbered ``current`` say so."""
    held = _item_texts(items)
    spans = item_spans(items, query, regex, case_sensitive).withColumn("hit", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("start")) - 1)
    place = held.select("doc_id", "page", "item_no", "k")
    named = lambda c, k: place.select("doc_id", "page", F.col("item_no").alias(c), F.col("k").alias(k))
    spans = spans.join(named("first_item", "a"), ["doc_id", "page", "first_item"]).join(named("last_item", "b"), ["doc_id", "page", "last_item"])
    parts = spans.select("doc_id", "page", "hit", "start", "end", F.explode(F.sequence("a", "b")).alias("k"))
    parts = parts.join(held.select("doc_id", "page", "k", "at", F.length("str").alias("n")), ["doc_id", "page", "k"])
    part = F.struct(F.greatest(F.col("start") - F.col("at"), F.lit(0)).alias("start"), F.least(F.col("end") - F.col("at"), F.col("n")).alias("end"), "hit")
    lists = parts.groupBy("doc_id", "page", "k").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    rows = items.select("doc_id", "page", "item_no", "str").join(place, ["doc_id", "page", "item_no"], "left").join(lists, ["doc_id", "page", "k"], "left")

    def add(done: Column, x: Column) -> Column:
        tag = F.when(F.coalesce(x["hit"] == F.lit(current), F.lit(False)), '<mark class="search-hit" data-current="true">').otherwise('<mark class="search-hit">')
        text = F.concat(done["text"], F.substring("str", done["upto"] + 1, x["start"] - done["upto"]), tag, F.substring("str", x["start"] + 1, x["end"] - x["start"]), F.lit("</mark>"))
        return F.struct(text.alias("text"), x["end"].alias("upto"))

    done = F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit(0).alias("upto")), add, lambda d: F.concat(d["text"], F.substring("str", d["upto"] + 1, F.length("str"))))
    return rows.select("doc_id", "page", "item_no", F.when(F.col("parts").isNull(), F.col("str")).otherwise(done).alias("marked"))
