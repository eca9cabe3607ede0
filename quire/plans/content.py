"""Queries over documents as blocks: structure, chunks, tags, keywords, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import chunks, contracts, html
from quire.plans.registry import query, table
from quire.sources import blocks as b

#: The block model in SQL, for the queries below.
BLOCKS = r"""WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
typed AS (
  SELECT doc_id, pos, printf('b%04d', pos + 1) AS block_id, text,
    CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '^([-*]|[0-9]+[.)]) ') THEN 'list'
      WHEN regexp_matches(text, '^[^:|]{2,40}: .+') THEN 'key_value' WHEN (pos = 0 AND length(text) <= 80) OR length(text) <= 16 THEN 'heading' ELSE 'paragraph' END AS type FROM lines),
blocks AS (SELECT *, CASE WHEN type = 'heading' THEN CASE WHEN pos = 0 THEN 1 WHEN length(text) >= 10 THEN 2 ELSE 3 END END AS level FROM typed)
"""
_CJK = "(length({0}) - length(regexp_replace({0}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')))"
TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, CAST(floor(" + _CJK + " / 1.5 + (length({0}) - " + _CJK + ") / 4.0) AS INTEGER)) END"
_WORDS = r"list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,8}}'), lambda w: lower(w)), lambda w: w NOT IN ('the','and','for','with','that','this','are','was','not','you','all','but','can','from','has','have'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(BLOCKS + "SELECT doc_id, pos, block_id, type, level, text FROM blocks")
def s01_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exploded to typed blocks with their place."""
    return b.blocks(_docs(spark, sf_dir))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations)),
    g AS (SELECT *, sum(CASE WHEN trim(line) = '' OR starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS grp FROM l)
    SELECT conv_id, turn, CAST(grp AS BIGINT) AS paragraph, string_agg(line, ' ' ORDER BY pos) AS text, count(*) AS n_lines FROM g WHERE trim(line) <> '' GROUP BY ALL"""
)
def s09_markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered to paragraphs between blank lines and headings (gaps and islands)."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    starts = (F.trim("line") == "") | F.col("line").startswith("#")
    marked = lines.withColumn("paragraph", F.sum(starts.cast("long")).over(W.partitionBy("conv_id", "turn").orderBy("pos")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return marked.where(F.trim("line") != "").groupBy("conv_id", "turn", "paragraph").agg(joined.alias("text"), F.count("*").alias("n_lines"))


@query("SELECT doc_id, substr('external_' || sha256(text), 1, 21) AS external_id, 'sha256:' || sha256(text) AS text_hash, printf('raw_b%04d', 1) AS first_chunk_id FROM documents")
def s14_fallback_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids derived from content."""
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.concat(F.lit("external_"), F.sha2("text", 256)), 1, 21).alias("external_id"), t.text_hash(F.col("text")).alias("text_hash"), F.format_string("raw_b%04d", F.lit(1)).alias("first_chunk_id"))


@query(BLOCKS + "SELECT doc_id, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (type <> 'empty') / CAST(count(*) AS DOUBLE), 4) END AS trace_coverage FROM blocks GROUP BY doc_id")
def s15_trace_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of blocks that carry text and so can be traced; 1.0 where there are none."""
    return b.blocks(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.round(t.safe_ratio(F.count_if(F.col("type") != "empty").cast("double"), F.count("*"), 1.0), 4).alias("trace_coverage"))


#: Paths of titles by windows: a path begins at each heading of level 1, and at a document's first heading; its second part is the last heading of level 2, or the first one after the beginning.
PATHS = BLOCKS + """, h AS (SELECT doc_id, pos, level, text, level = 1 OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS begins FROM blocks WHERE type = 'heading'),
g AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM h), k AS (SELECT *, row_number() OVER w AS k, first_value(text) OVER w AS p0 FROM g WINDOW w AS (PARTITION BY doc_id, part ORDER BY pos)),
q AS (SELECT *, last_value(CASE WHEN k > 1 AND (level = 2 OR k = 2) THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY pos) AS p1 FROM k),
paths AS (SELECT doc_id, pos, CASE WHEN k = 1 THEN p0 WHEN level = 2 OR k = 2 THEN p0 || ' > ' || p1 ELSE p0 || ' > ' || p1 || ' > ' || text END AS title_path FROM q)"""


@query(PATHS + " SELECT doc_id, pos, title_path FROM paths")
def w01_title_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of titles at each heading."""
    return b.title_paths(_docs(spark, sf_dir))


@query(PATHS + ", f AS (SELECT b.doc_id, b.pos, b.type, last_value(p.title_path IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS title_path FROM blocks b LEFT JOIN paths p ON p.doc_id = b.doc_id AND p.pos = b.pos) SELECT doc_id, pos, coalesce(title_path, '') AS title_path FROM f WHERE type <> 'empty'")
def x05_block_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of titles that each block stands under."""
    return contracts.block_title_paths(_docs(spark, sf_dir))


@query(
    BLOCKS
    + """, s AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM blocks)
    SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_blocks, CAST(min(pos) AS BIGINT) AS first_pos, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section"""
)
def w02_section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between headings and what they hold."""
    return b.sections(b.blocks(_docs(spark, sf_dir))).groupBy("doc_id", "section").agg(F.count("*").alias("n_blocks"), F.min("pos").cast("long").alias("first_pos"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(BLOCKS + ", x AS (SELECT doc_id, pos, type, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, before, after FROM x WHERE type IN ('table', 'list', 'key_value')")
def w06_neighbour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks before and after each structured block."""
    w = W.partitionBy("doc_id").orderBy("pos")
    return b.blocks(_docs(spark, sf_dir)).withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)}).where(F.col("type").isin("table", "list", "key_value")).select("doc_id", "pos", "before", "after")


@query(
    BLOCKS
    + """, h AS (SELECT *, max(CASE WHEN type = 'heading' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM blocks)
    SELECT h.doc_id, h.pos, h.head AS heading_pos, k.text AS heading FROM h JOIN blocks k ON k.doc_id = h.doc_id AND k.pos = h.head WHERE h.type <> 'heading' AND h.pos - h.head <= 8"""
)
def w04_heading_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the nearest heading within eight blocks before it."""
    w = W.partitionBy("doc_id").orderBy("pos")
    head = F.last(F.when(F.col("type") == "heading", F.struct("pos", "text")), ignorenulls=True).over(w)
    near = b.blocks(_docs(spark, sf_dir)).withColumn("h", head).where((F.col("type") != "heading") & F.col("h").isNotNull() & (F.col("pos") - F.col("h.pos") <= 8))
    return near.select("doc_id", "pos", F.col("h.pos").alias("heading_pos"), F.col("h.text").alias("heading"))


@query(BLOCKS + f"SELECT doc_id, block_id AS chunk_id, pos AS chunk_index, type, {TOKENS.format('text')} AS token_count, 'sha256:' || sha256(text) AS text_hash FROM blocks WHERE type <> 'empty'")
def c03_chunk_source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each block that is not empty, with its tokens."""
    return chunks.source_block_aware(b.blocks(_docs(spark, sf_dir))).select("doc_id", "chunk_id", "chunk_index", "type", "token_count", "text_hash")


@query()
def c02_chunk_heading_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing to a token budget, flushed at headings and protected blocks; tests hold a loop against it."""
    return chunks.greedy(_docs(spark, sf_dir), max_tokens=256, with_headings=True)


@query()
def c04_chunk_table_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As heading_aware, but heading texts are dropped."""
    return chunks.greedy(_docs(spark, sf_dir), max_tokens=256, with_headings=False)


@query()
def c05_chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents at level-1 headings, children packed within them."""
    return chunks.parent_child(_docs(spark, sf_dir), max_tokens=256)


@query(
    BLOCKS
    + f""", k AS (SELECT doc_id, type, {TOKENS.format("text")} AS n FROM blocks)
    SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 16 THEN 'short' WHEN n > 256 THEN 'overlong' ELSE 'ok' END AS length_class, type, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS tokens, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most FROM k GROUP BY ALL"""
)
def c12_length_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by length class and type."""
    n = t.estimate_tokens(F.col("text"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("n") < 16, "short").when(F.col("n") > 256, "overlong").otherwise("ok")
    return b.blocks(_docs(spark, sf_dir)).withColumn("n", n).groupBy(kind.alias("length_class"), "type").agg(F.count("*").alias("n_chunks"), F.sum("n").cast("long").alias("tokens"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"))


@query(
    BLOCKS
    + """, f AS (SELECT doc_id, pos, list_filter([CASE WHEN type IN ('table', 'list') THEN 'protected' END, CASE WHEN type = 'heading' THEN 'title' END, CASE WHEN length(text) > 4000 THEN 'oversized' END,
      CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'has_number' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END], lambda x: x IS NOT NULL) AS tags FROM blocks)
    SELECT doc_id, pos, array_to_string(list_sort(tags), ',') AS tags FROM f WHERE len(tags) > 0"""
)
def c10_content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by rules over type and terms."""
    text, kind = F.col("text"), F.col("type")
    rules = {"protected": kind.isin("table", "list"), "title": kind == "heading", "oversized": F.length(text) > 4000, "has_number": text.rlike("[0-9]{4}"), "license": F.contains(F.lower(text), F.lit("license"))}
    return chunks.tagged(b.blocks(_docs(spark, sf_dir)), rules).where(F.size("tags") > 0).select("doc_id", "pos", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens, length(text) AS n_chars_seen, len(regexp_extract_all(text, '[^。！？!?\\n.]+[。！？!?.]*')) AS n_sentences FROM documents")
def f13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens and sentences of each document."""
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", t.estimate_tokens(c).alias("tokens"), F.length(c).alias("n_chars_seen"), F.size(t.sentences(c)).alias("n_sentences"))


@query(f"WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 8")
def o01_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent keywords of each document (a top-k report)."""
    return chunks.keywords(_docs(spark, sf_dir), 8)


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents")
def f12_normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """white space folded."""
    return _docs(spark, sf_dir).select("doc_id", t.normalize_spaces(F.col("text")).alias("text"))


@query(
    "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE ("
    + " + ".join(f"CAST((length(text) - length(replace(text, '{m}', ''))) / {len(m)} AS INTEGER)" for m in t.MOJIBAKE)
    + ") / CAST(length(text) AS DOUBLE) END AS ratio FROM documents"
)
def f44_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share of wrongly decoded characters."""
    return _docs(spark, sf_dir).select("doc_id", t.mojibake_ratio(F.col("text")).alias("ratio"))


@query(BLOCKS + "SELECT doc_id, pos, trim(regexp_extract(text, '^([^:|]{2,40}): (.+)', 1)) AS source_name, regexp_extract(text, '^([^:|]{2,40}): (.+)', 2) AS sample, regexp_replace(lower(trim(regexp_extract(text, '^([^:|]{2,40}): (.+)', 1))), '[ \\t_-]+', '', 'g') AS normalized FROM blocks WHERE type = 'key_value'")
def x07_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from `key: value` lines."""
    part = lambda k: F.regexp_extract("text", r"^([^:|]{2,40}): (.+)", k)
    rows = b.blocks(_docs(spark, sf_dir)).where("type = 'key_value'")
    return rows.select("doc_id", "pos", F.trim(part(1)).alias("source_name"), part(2).alias("sample"), F.regexp_replace(F.lower(F.trim(part(1))), r"[ \t_-]+", "").alias("normalized"))


_PATTERNS = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]{2,}", "digits": r"[0-9]{7,}", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "url": r"https?://[a-z0-9./-]+"}


@query("WITH " + ", ".join(f"{k} AS (SELECT doc_id, '{k}' AS kind, unnest(list_slice(regexp_extract_all(text, '{p}'), 1, 10)) AS value FROM documents)" for k, p in _PATTERNS.items()) + " " + " UNION ALL ".join(f"SELECT * FROM {k}" for k in _PATTERNS))
def x08_regex_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of patterns, ten of each in a document at most, in order of appearance."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.slice(F.regexp_extract_all("text", F.lit(p), F.lit(0)), 1, 10).alias("values")) for k, p in _PATTERNS.items()])
    return _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.kind", F.explode("x.values").alias("value"))


@query(
    BLOCKS
    + """, d AS (SELECT doc_id, pos, text, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM blocks WHERE length(text) >= 40)
    SELECT first.d AS first_doc, first.p AS first_pos, count(*) - 1 AS duplicates FROM d WHERE n > 1 GROUP BY first"""
)
def g09_duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that repeat an earlier block's text, by the first. Grouped by hash with partial counts, so a hot text is one row a task."""
    rows = b.blocks(_docs(spark, sf_dir)).where(F.length("text") >= 40)
    groups = rows.groupBy(F.sha2("text", 256)).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return groups.select(F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"), (F.col("n") - 1).alias("duplicates"))


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def g29_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one document holds."""
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS content, count(*) AS n_blocks FROM conversations GROUP BY conv_id")
def g04_aggregate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a document from its blocks, in order."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.trim(x["text"]) != "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.nullif(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), F.lit("")).alias("content"), F.count("*").alias("n_blocks"))


@query("SELECT doc_id, (n_chars > 20000) OR length(text) > 20000 AS too_long, len(string_split(text, chr(10))) > 200 AS too_many_blocks, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest_block FROM documents")
def p14_resource_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits on documents and blocks, as flags."""
    lines = F.split("text", "\n")
    return _docs(spark, sf_dir).select("doc_id", ((F.col("n_chars") > 20000) | (F.length("text") > 20000)).alias("too_long"), (F.size(lines) > 200).alias("too_many_blocks"), F.array_max(F.transform(lines, F.length)).alias("longest_block"))


@query("SELECT doc_id, unnest(range(1, greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)) + 1)) AS slice, substr(text, (unnest(range(1, greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)) + 1)) - 1) * 800 + 1, 800) AS text FROM documents WHERE length(text) > 0")
def k05_fixed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of 800 characters."""
    n = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(F.length("text") / 800)).cast("long"))
    return _docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text", F.explode(n).alias("slice")).select("doc_id", "slice", F.substring("text", ((F.col("slice") - 1) * 800 + 1).cast("int"), F.lit(800)).alias("text"))


_MD = "CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list' THEN '- ' || regexp_replace(text, '^([-*]|[0-9]+[.)]) ', '') WHEN 'table' THEN '| ' || text || ' |' ELSE text END"


@query(BLOCKS + f"SELECT doc_id, 'sha256:' || sha256(string_agg({_MD}, chr(10) ORDER BY pos)) AS markdown_hash, count(*) AS n_blocks FROM blocks GROUP BY doc_id")
def k03_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered as Markdown, by hash."""
    return chunks.markdown(b.blocks(_docs(spark, sf_dir))).select("doc_id", t.text_hash(F.col("markdown")).alias("markdown_hash"), "n_blocks")


@query(BLOCKS + f"SELECT doc_id || '_' || block_id AS id, doc_id, text, type AS granularity, {TOKENS.format('text')} AS token_count FROM blocks WHERE type <> 'empty' AND length(text) >= 24")
def k06_rag_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a retrieval corpus, long enough and not empty."""
    rows = b.blocks(_docs(spark, sf_dir)).where((F.col("type") != "empty") & (F.length("text") >= 24))
    return rows.select(F.concat_ws("_", "doc_id", "block_id").alias("id"), "doc_id", "text", F.col("type").alias("granularity"), t.estimate_tokens(F.col("text")).alias("token_count"))


@query("SELECT 'documents/' || doc_id || '.txt' AS path, 'sha256:' || sha256(text) AS checksum, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, 'text/plain' AS media_type, true AS required FROM documents")
def k10_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row for each document's file."""
    return _docs(spark, sf_dir).select(F.concat(F.lit("documents/"), F.col("doc_id"), F.lit(".txt")).alias("path"), t.text_hash(F.col("text")).alias("checksum"), F.octet_length("text").cast("long").alias("bytes"), F.lit("text/plain").alias("media_type"), F.lit(True).alias("required"))


@query("SELECT count(*) AS rows, count(*) FILTER (doc_id IS NULL) AS missing_doc_id, count(*) FILTER (text IS NULL OR text = '') AS missing_text, count(*) FILTER (source IS NULL) AS missing_source, bool_and(doc_id IS NOT NULL AND text IS NOT NULL AND text <> '' AND source IS NOT NULL) AS passed FROM documents")
def k12_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required paths of the downstream contract over all rows."""
    good = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & F.col("source").isNotNull()
    return _docs(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("missing_doc_id"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("missing_text"), F.count_if(F.col("source").isNull()).alias("missing_source"), F.bool_and(good).alias("passed"))


@query()
def s06_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of raw web pages, by their content roots, lists, tables and layout; tests hold the rules."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>.*?</title>') <> '' AS has_title, 'extracted' AS status FROM pages")
def s06_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages have a title and are extracted."""
    return html.pages_read(table(spark, sf_dir, "pages")).select("page_id", (F.col("title") != "").alias("has_title"), "status")


@query("SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def x19_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of page addresses, and the raw title."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, "^(https?)://", 1)).alias("scheme"), F.lower(F.regexp_extract(u, "^https?://([^/?#:]+)", 1)).alias("host"), F.regexp_extract(u, "^https?://[^/?#]+(/[^?#]*)", 1).alias("path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n_chars"))
