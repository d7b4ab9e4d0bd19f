"""One registered query for each operator, over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .chat import Template, format_chats, read_back, unescape
from .common import table
from .decontam import leak_rows
from .fingerprints import edited_fingerprints, shown
from .html_extract import extract
from .lexical import search
from .licences import licence_sql, scan_licences
from .line_dedup import remove_repeated_lines
from .negatives import mine_hard_negatives
from .pieces import encode_and_check, load
from .simhash import near_duplicates
from .sharding import shuffle_into_shards
from .toxicity import score_toxicity


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(docs, n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What law and slots of ``op1_hypergeometric_shards`` promise, counted from its rows."""
    return op1_hypergeometric_shards(spark, sf_dir).groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.countDistinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probes = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    template = Template()
    out = format_chats(given.unionByName(probes), template)
    turns = F.transform(read_back(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.withColumn("text", extract(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", encode_and_check(F.col("text"), load(spark)).alias("e"))
    return coded.select("doc_id", F.when(F.col("e.ids").isNotNull(), F.size("e.ids")).alias("n_pieces"), "e.ids", "e.same")


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_rows(docs, table(spark, sf_dir, "benchmark"))


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs)


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("signature")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


_OP10_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM docs WHERE len(lines) >= 3),
o AS (SELECT doc_id, pos, lines[pos] AS a, lines[pos + 1] AS b, lines[pos + 2] AS c FROM w),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM o) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM later),
per AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN p.gone IS NULL THEN d.text
       ELSE array_to_string([x[1] FOR x IN list_zip(d.lines, range(1, len(d.lines) + 1)) IF NOT list_contains(p.gone, x[2])], chr(10)) END AS text,
  CAST(len(d.lines) AS INTEGER) AS n_lines, CAST(coalesce(len(p.gone), 0) AS INTEGER) AS n_removed
FROM docs d LEFT JOIN per p USING (doc_id)
"""


_SHARDS_SQL = """
WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(i AS INTEGER) AS shard, CAST(n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END AS BIGINT) AS n FROM t, range(40) r(i))
SELECT shard, n AS n_rows, n AS n_slots, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot FROM s WHERE n > 0
"""

#: For pages of the given tables' shape, which all mark their article; tests/llm has others.
_OP5_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(?:p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '</?[A-Za-z][^>]*(?:>|\z)', '', 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_filter([trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN parts], lambda y: y != '') AS lines FROM b)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, CAST(length(array_to_string(lines, chr(10))) AS BIGINT) AS n_chars FROM c
"""

_OP4_SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(\[|<)(/?(?:INST|SYS|ROLE)\]|/TURN\]|/?s>)', '\1\\\2', 'g') AS esc,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM rows_),
f AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4 ELSE 22 + length(role) END AS extra,
  (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS good FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(esc) + extra) AS BIGINT) AS formatted_chars,
  bool_and(good) AND bool_or(back = 1 AND role IN ('user', 'assistant')) AS valid
FROM f GROUP BY conv_id
"""

_OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

_OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
w AS (SELECT doc_id, n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_hypergeometric_shards, op2_multiprobe_neighbours, op3_simhash_components, op4_chat_turns, op5_page_text, op6_licence_scan, op7_piece_roundtrip, op8_toxicity_scores, op9_benchmark_leaks, op10_line_windows, op11_weighted_fingerprints, op12_hard_negatives, op13_ranked_search, shard_sizes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_turns": _OP4_SQL, "op5_page_text": _OP5_SQL, "op6_licence_scan": licence_sql(), "op10_line_windows": _OP10_SQL, "op12_hard_negatives": _OP12_SQL, "op13_ranked_search": _OP13_SQL, "shard_sizes": _SHARDS_SQL}
