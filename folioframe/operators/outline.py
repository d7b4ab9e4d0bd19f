"""Outlines as flat rows: outline(doc_id, node_id, parent_id, sib_index from 0, title, source_id,
source_index). ``flatten`` adds depth, preorder and n_below; every edit works on all documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.durable import remove_folder, shared_folder, written
from .manifest import source_order

OUTLINE = ["doc_id", "node_id", "parent_id", "sib_index", "title", "source_id", "source_index"]
_KEYS = ["doc_id", "node_id"]


def _siblings():
    return Window.partitionBy("doc_id", "parent_id").orderBy("sib_index")


def resolve_dests(raw: DataFrame, named_dests: DataFrame, page_refs: DataFrame) -> DataFrame:
    """Raw outline rows (source_id, node_id, parent_id, sib_index, title, dest_name, dest_ref) with
    source_index: a name leads to a reference, a reference to a page; what fails is null."""
    names = named_dests.select("source_id", F.col("name").alias("dest_name"), F.col("ref").alias("named_ref"))
    refs = page_refs.select("source_id", F.col("ref").alias("target"), "source_index")
    rows = raw.join(names, ["source_id", "dest_name"], "left").withColumn("target", F.when(F.col("dest_name").isNotNull(), F.col("named_ref")).otherwise(F.col("dest_ref")))
    return rows.join(refs, ["source_id", "target"], "left").select("source_id", "node_id", "parent_id", "sib_index", "title", "source_index")


def collect_outlines(manifest: DataFrame, outlines: DataFrame) -> DataFrame:
    """The outlines (source_id, ...) of a document's sources, in the order in which the sources appear."""
    rows = source_order(manifest).select("doc_id", "source_id", "source_rank").join(outlines, "source_id")
    ident = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("-", "doc_id", "source_id", c))
    rows = rows.withColumn("node_id", ident("node_id")).withColumn("parent_id", ident("parent_id"))
    order = Window.partitionBy("doc_id", "parent_id").orderBy("source_rank", "sib_index")
    return rows.withColumn("sib_index", F.row_number().over(order) - 1).select(*OUTLINE)


def from_resolved(rows: DataFrame, doc_id: Column) -> DataFrame:
    return rows.withColumn("doc_id", doc_id).select(*OUTLINE)


def to_build(outline: DataFrame) -> DataFrame:
    """What a writer needs, without ids: (doc_id, depth, preorder, title, source_id, source_index)."""
    return flatten(outline).select("doc_id", "depth", "preorder", "title", "source_id", "source_index")


def new_nodes(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Leaves for ``requests`` (doc_id, node_id, page, title): a title of its own or the page's number,
    the target of the page shown, or of the first source with no page."""
    shown = manifest.select("doc_id", F.col("position").alias("page"), "source_id", "source_index")
    first = source_order(manifest).filter("source_rank = 1").select("doc_id", F.col("source_id").alias("first_source"))
    rows = requests.join(shown, ["doc_id", "page"], "left").join(first, "doc_id", "left")
    title = F.coalesce("title", F.concat(F.lit("ページ "), F.col("page").cast("string")))
    return rows.select("doc_id", "node_id", title.alias("title"), F.coalesce("source_id", "first_source").alias("source_id"), "source_index")


def build_outline(raw: DataFrame, named_dests: DataFrame, page_refs: DataFrame) -> DataFrame:
    """A source's own outline, resolved and in reading order: (source_id, node_id, parent_id, sib_index, title,
    source_index, depth, preorder)."""
    rows = resolve_dests(raw, named_dests, page_refs)
    flat = flatten(from_resolved(rows, F.col("source_id")))
    return flat.select("source_id", "node_id", "parent_id", "sib_index", "title", "source_index", "depth", "preorder")


def _doubled(rows: DataFrame) -> DataFrame:
    """One round for rows (doc_id, node_id, up, depth, lost, size): a node points twice as far up, and has counted twice as
    far down, as before; the counts of those that pointed to it are added."""
    above = rows.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more_depth"), F.col("lost").alias("is_lost"))
    below = rows.filter("up IS NOT NULL").groupBy("doc_id", F.col("up").alias("node_id")).agg(F.sum("size").alias("more"))
    return rows.join(below, _KEYS, "left").join(above, ["doc_id", "up"], "left").select(
        *_KEYS, F.col("further").alias("up"), (F.col("depth") + F.coalesce("more_depth", F.lit(0))).alias("depth"),
        (F.col("lost") | F.coalesce("is_lost", F.lit(False))).alias("lost"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
    )


#: Documents of up to this many nodes are walked as a whole, many of them by one task.
NODES_PER_WALK = 16_384


def flatten(outline: DataFrame, nodes_per_walk: int = NODES_PER_WALK) -> DataFrame:
    """Outline rows with depth, preorder and n_below: what lies below a node are the n_below rows after it in preorder.

    Rows are dealt by document once, and a task walks through one document after the other. Larger documents go node by
    node: subtrees are counted and places summed along the way to the root by pointers that double, so rounds grow with
    the logarithm of the depth, and no row holds its path. Siblings of one sib_index go by node_id. Rows without a doc_id
    or node_id don't count; rows whose parents never lead to a root are an error. Rows are written to the shared folder
    when this is called; the last stay.
    """
    spark, folder = outline.sparkSession, f"{shared_folder(outline.sparkSession)}/tree-{uuid.uuid4().hex}"
    rows = written(outline.filter("doc_id IS NOT NULL AND node_id IS NOT NULL").select(*OUTLINE), f"{folder}/rows")
    large = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > nodes_per_walk).select("doc_id"), f"{folder}/large")
    if large.isEmpty():
        out = _walked(rows, f"{folder}/walked")
        remove_folder(spark, f"{folder}/rows")
        return out
    small = _walked(rows.join(F.broadcast(large), "doc_id", "left_anti"), f"{folder}/walked")
    return small.unionByName(_pointed(rows.join(F.broadcast(large), "doc_id", "left_semi"), folder))


def _walked(rows: DataFrame, path: str) -> DataFrame:
    kinds = StructType(rows.schema.fields + [StructField("depth", IntegerType()), StructField("preorder", IntegerType()), StructField("n_below", LongType())])
    out = written(rows.repartition("doc_id").sortWithinPartitions("doc_id", "sib_index", "node_id").mapInArrow(_walk, kinds), path)
    bad = out.filter("preorder IS NULL").count()
    if bad:
        raise ValueError(f"{bad} rows lie under no root")
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and sibling, with their places; a document's rows are held until the next one begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column("doc_id")
        last = docs[len(docs) - 1]
        n = pc.index(docs, last).as_py()  # where the last document begins
        if n or held and held[-1].column("doc_id")[0] != last:
            yield from _placed(held + [batch.slice(0, n)])
            held = []
        held.append(batch.slice(n))
    yield from _placed(held)


def _placed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    docs, nodes, ups = (table.column(c).to_pylist() for c in ("doc_id", "node_id", "parent_id"))
    at = {key: i for i, key in enumerate(zip(docs, nodes))}
    above = [-1 if up is None else at.get((doc, up)) for doc, up in zip(docs, ups)]
    children: list[list[int]] = [[] for _ in docs]
    for i in range(len(docs) - 1, -1, -1):  # the first child lies on top
        if above[i] is not None and above[i] >= 0:
            children[above[i]].append(i)
    depth, place, below, order = [None] * len(docs), [None] * len(docs), [0] * len(docs), []
    doc, n = None, 0
    for root, up in enumerate(above):
        if up != -1:
            continue
        if docs[root] != doc:
            doc, n = docs[root], 0
        depth[root], todo = 0, [root]
        while todo:
            i = todo.pop()
            place[i], n = n, n + 1
            order.append(i)
            for child in children[i]:
                depth[child] = depth[i] + 1
            todo += children[i]
    for i in reversed(order):
        if above[i] >= 0:
            below[above[i]] += below[i] + 1
    more = {"depth": pa.array(depth, pa.int32()), "preorder": pa.array(place, pa.int32()), "n_below": pa.array(below, pa.int64())}
    for name, column in more.items():
        table = table.append_column(name, column)
    yield from table.combine_chunks().to_batches()


def _pointed(outline: DataFrame, folder: str) -> DataFrame:
    spark, rows = outline.sparkSession, written(outline, f"{folder}/pointed")
    total = rows.count()
    known = rows.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    ways = rows.select(*_KEYS, "parent_id").join(known, ["doc_id", "parent_id"], "left")
    ways = written(ways.select(
        *_KEYS, F.when(F.col("known"), F.col("parent_id")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("depth"),
        (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("lost"), F.lit(1).cast("bigint").alias("size"),
    ), f"{folder}/ways-0")
    rounds = 0
    while rounds <= total.bit_length() and not ways.filter("up IS NOT NULL").isEmpty():
        ways, rounds = written(_doubled(ways), f"{folder}/ways-{rounds + 1}"), rounds + 1
        remove_folder(spark, f"{folder}/ways-{rounds - 1}")
    bad = ways.filter("lost OR up IS NOT NULL").count()
    if bad:
        raise ValueError(f"{bad} rows lie under no root")
    sized = rows.join(ways.select(*_KEYS, "depth", "size"), _KEYS)
    earlier = Window.partitionBy("doc_id", "parent_id").orderBy("sib_index", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    places = sized.select(*_KEYS, F.col("parent_id").alias("up"), step.alias("place"))
    for i in range(rounds):
        places = written(places, f"{folder}/places-{i}")
        if i > 1:
            remove_folder(spark, f"{folder}/places-{i - 2}")
        above = places.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("place").alias("more"))
        places = places.join(above, ["doc_id", "up"], "left").select(*_KEYS, F.col("further").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
    sized = sized.select(*OUTLINE, "depth", (F.col("size") - 1).alias("n_below"))
    out = sized.join(places.select(*_KEYS, F.col("place").cast("int").alias("preorder")), _KEYS)
    return out.select(*OUTLINE, "depth", "preorder", "n_below")


def rebuild(items: DataFrame) -> DataFrame:
    """Outline rows from items (doc_id, node_id, parent_id, item_no, title, source_id, source_index):
    children go in item order, an unknown parent means a root."""
    known = items.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    rows = items.join(known, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id")))
    order = Window.partitionBy("doc_id", "parent_id").orderBy("item_no")
    return rows.withColumn("sib_index", F.row_number().over(order) - 1).select(*OUTLINE)


def closure(flat: DataFrame) -> DataFrame:
    """(doc_id, ancestor_id, node_id) of all pairs above each other."""
    return descendants(flat, flat)


def descendants(flat: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, ancestor_id, node_id) of all that lies below ``ids`` (doc_id, node_id)."""
    wanted = flat.join(ids.select(*_KEYS).distinct(), _KEYS, "left_semi").filter("n_below > 0")
    places = F.sequence(F.col("preorder") + 1, (F.col("preorder") + F.col("n_below")).cast("int"))
    pairs = wanted.select("doc_id", F.col("node_id").alias("ancestor_id"), F.explode(places).alias("preorder"))
    return pairs.join(flat.select("doc_id", "preorder", "node_id"), ["doc_id", "preorder"]).select("doc_id", "ancestor_id", "node_id")


def _below(flat: DataFrame, ids: DataFrame) -> DataFrame:
    """``flat`` with ``hit`` (in ``ids``) and ``below`` (under one of them): subtrees are intervals of preorder, nested or
    apart, so the furthest end so far says whether a row lies in one."""
    marked = flat.join(ids.select(*_KEYS).distinct().withColumn("hit", F.lit(True)), _KEYS, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    before = Window.partitionBy("doc_id").orderBy("preorder").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("hit"), F.col("preorder") + F.col("n_below"))).over(before)
    return marked.withColumn("below", F.coalesce(F.col("preorder") <= reach, F.lit(False)))


def prune_below(flat: DataFrame, ids: DataFrame) -> DataFrame:
    return _below(flat, ids).filter("NOT below").select(*flat.columns)


def count_nodes(outline: DataFrame) -> DataFrame:
    return outline.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))


def count_descendants(flat: DataFrame) -> DataFrame:
    return flat.select(*_KEYS, F.col("n_below").alias("n_descendants"))


def rename(outline: DataFrame, edits: DataFrame) -> DataFrame:
    new = edits.select(*_KEYS, F.col("title").alias("new_title"))
    return outline.join(new, _KEYS, "left").withColumn("title", F.coalesce("new_title", "title")).select(*OUTLINE)


def _renumbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sib_index", F.row_number().over(_siblings()) - 1).select(*OUTLINE)


def remove(outline: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the nodes and all below them."""
    return _renumbered(_below(flatten(outline), ids).filter("NOT below AND NOT hit"))


def add_after(outline: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` is (doc_id, after_id, node_id, title, source_id, source_index), one for a document: next
    to ``after_id``, or last among the roots where that is null; an unknown one changes nothing."""
    last = outline.filter("parent_id IS NULL").groupBy("doc_id").agg((F.max("sib_index") + 1).alias("end"))
    at = outline.select("doc_id", F.col("node_id").alias("after_id"), F.col("parent_id").alias("at_parent"), F.col("sib_index").alias("at_index"))
    placed = new.join(at, ["doc_id", "after_id"], "left").join(last, "doc_id", "left").filter("after_id IS NULL OR at_index IS NOT NULL")
    rows = placed.select("doc_id", "node_id", F.col("at_parent").alias("parent_id"), F.coalesce(F.col("at_index") + 0.5, F.coalesce("end", F.lit(0)).cast("double")).alias("sib_index"), "title", "source_id", "source_index")
    return _renumbered(outline.select(*OUTLINE).withColumn("sib_index", F.col("sib_index").cast("double")).unionByName(rows))


def add_child(outline: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` is (doc_id, parent_id, node_id, title, source_id, source_index): last child of its parent."""
    last = outline.groupBy("doc_id", "parent_id").agg((F.max("sib_index") + 1).alias("end"))
    known = outline.select("doc_id", F.col("node_id").alias("parent_id"))
    order = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    rows = new.join(known, ["doc_id", "parent_id"], "left_semi").join(last, ["doc_id", "parent_id"], "left")
    rows = rows.withColumn("sib_index", (F.coalesce("end", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    return outline.select(*OUTLINE).unionByName(rows.select(*OUTLINE))


def move_in_siblings(outline: DataFrame, ids: DataFrame, step: int) -> DataFrame:
    """One place up (-1) or down (1) for one node of a document; at the edge nothing changes."""
    marked = outline.join(ids.select(*_KEYS, F.lit(True).alias("hit")), _KEYS, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    other = F.lead("hit").over(_siblings()) if step < 0 else F.lag("hit").over(_siblings())
    last = F.count("*").over(Window.partitionBy("doc_id", "parent_id")) - 1
    moves = F.col("hit") & ((F.col("sib_index") > 0) if step < 0 else (F.col("sib_index") < last))
    to = F.when(moves, F.col("sib_index") + step).when(F.coalesce(other, F.lit(False)), F.col("sib_index") - step).otherwise(F.col("sib_index"))
    return marked.withColumn("sib_index", to.cast("int")).select(*OUTLINE)


def move_up(outline: DataFrame, ids: DataFrame) -> DataFrame:
    return move_in_siblings(outline, ids, -1)


def move_down(outline: DataFrame, ids: DataFrame) -> DataFrame:
    return move_in_siblings(outline, ids, 1)


def indent(outline: DataFrame, ids: DataFrame) -> DataFrame:
    """One node of a document becomes the last child of the sibling before it; a first one stays."""
    marked = outline.withColumn("before", F.lag("node_id").over(_siblings())).join(ids.select(*_KEYS, F.lit(True).alias("hit")), _KEYS, "left")
    moves = F.coalesce(F.col("hit"), F.lit(False)) & F.col("before").isNotNull()
    moved = marked.withColumn("parent_id", F.when(moves, F.col("before")).otherwise(F.col("parent_id"))).withColumn("sib_index", F.when(moves, 2**30).otherwise(F.col("sib_index")))
    return _renumbered(moved)


def outdent(outline: DataFrame, ids: DataFrame) -> DataFrame:
    """One node of a document becomes the sibling right after its parent; a root stays."""
    up = outline.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("up_parent"), F.col("sib_index").alias("up_index"))
    marked = outline.join(ids.select(*_KEYS, F.lit(True).alias("hit")), _KEYS, "left").join(up, ["doc_id", "parent_id"], "left")
    moves = F.coalesce(F.col("hit"), F.lit(False)) & F.col("up_index").isNotNull()
    moved = marked.withColumn("sib_index", F.when(moves, F.col("up_index") + 0.5).otherwise(F.col("sib_index").cast("double")))
    return _renumbered(moved.withColumn("parent_id", F.when(moves, F.col("up_parent")).otherwise(F.col("parent_id"))))


def move_subtree(outline: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` is (doc_id, node_id, new_parent, over_id), one for a document: in the flat list the
    node goes to where ``over_id`` stands, and under ``new_parent``; what is below it follows."""
    items = flatten(outline).withColumn("item_no", F.col("preorder"))
    places = items.select("doc_id", "node_id", "preorder")
    ends = moves.join(places.withColumnRenamed("preorder", "a"), _KEYS).join(places.select("doc_id", F.col("node_id").alias("over_id"), F.col("preorder").alias("b")), ["doc_id", "over_id"])
    both = items.join(ends.select("doc_id", "a", "b", "new_parent", F.col("node_id").alias("moved")), "doc_id", "left")
    i, a, b = F.col("item_no"), F.col("a"), F.col("b")
    to = F.when(i == a, b).when((a < b) & i.between(a + 1, b), i - 1).when((a > b) & i.between(b, a - 1), i + 1).otherwise(i)
    is_moved = F.coalesce(F.col("node_id") == F.col("moved"), F.lit(False))
    return rebuild(both.withColumn("item_no", to).withColumn("parent_id", F.when(is_moved, F.col("new_parent")).otherwise(F.col("parent_id"))))


def remap(outline: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outline rows with output_page from 1: the first page that shows the target, or null."""
    first = manifest.groupBy("doc_id", "source_id", "source_index").agg(F.min("position").alias("output_page"))
    return outline.join(first, ["doc_id", "source_id", "source_index"], "left").select(*OUTLINE, "output_page")


def links(flat: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, prev_id, next_id, first_child, last_child, n_below)."""
    children = flat.filter("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "sib_index").alias("first_child"), F.max_by("node_id", "sib_index").alias("last_child"))
    rows = flat.select(*_KEYS, "parent_id", F.lag("node_id").over(_siblings()).alias("prev_id"), F.lead("node_id").over(_siblings()).alias("next_id"))
    return rows.join(children, _KEYS, "left").join(count_descendants(flat).withColumnRenamed("n_descendants", "n_below"), _KEYS, "left")


def outline_dirty(log: DataFrame) -> DataFrame:
    """(doc_id, dirty) from (doc_id, seq, action): an edit after the last load or save."""
    edit = F.max(F.when(F.col("action") == "edit", F.col("seq")))
    kept = F.max(F.when(F.col("action").isin("load", "save"), F.col("seq")))
    return log.groupBy("doc_id").agg(F.coalesce(edit > F.coalesce(kept, F.lit(-1)), F.lit(False)).alias("dirty"))
