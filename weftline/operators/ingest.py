"""From documents to chunks, and the tables' upserts, replacements and deletions written as joins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.functions.text import slugify, token_count
from weftline.operators.graph import entity_records, relation_records
from weftline.operators.retrieval import live_chunks, live_documents
from weftline.operators.skew import hub_join
from weftline.session import cut_table, pick, spread, table
from weftline.sources.readers import html_sections, markdown_sections

_END = re.compile(r"(?<=[.!?])\s+")


def pack(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed into chunks of `size` words at most; each further chunk opens with the last `overlap` words
    of all that was read before it. A single longer sentence stays whole."""
    out: list[str] = []
    now: list[str] = []
    fresh = 0
    history: list[str] = []
    for sentence in _END.split(text or ""):
        words = sentence.split()
        if not words:
            continue
        if fresh and len(now) + len(words) > size:
            out.append(" ".join(now))
            now, fresh = history[-overlap:] if overlap else [], 0
        now = now + words
        fresh += len(words)
        history = (history + words)[-max(overlap, 1) :]
    if fresh:
        out.append(" ".join(now))
    return out


def chunk_sections(sections: DataFrame, id_col: str, size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """id_col, chunk_index, section_no, chunk_text, token_count. sections: id_col, section_no, text.

    A section of `size` words at most is one chunk. Chunks under `least` words are dropped, but the largest of a
    document (the first of equal ones) stays if all would be; the rest is numbered from 0."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [t] if t is not None and len(t.split()) <= size else pack(t or "", size, overlap))

    parts = sections.select(id_col, "section_no", F.posexplode(packed("text")).alias("part", "chunk_text")).withColumn("token_count", token_count(F.col("chunk_text"))).filter("token_count > 0")
    best = Window.partitionBy(id_col).orderBy(F.desc("token_count"), "section_no", "part")
    kept = parts.withColumn("r", F.row_number().over(best)).filter((F.col("token_count") >= least) | (F.col("r") == 1))
    order = Window.partitionBy(id_col).orderBy("section_no", "part")
    most = Window.partitionBy(id_col)
    kept = kept.withColumn("top", F.max("token_count").over(most)).filter((F.col("token_count") >= least) | (F.col("top") < least))
    return kept.withColumn("chunk_index", F.row_number().over(order) - 1).select(id_col, "chunk_index", "section_no", "chunk_text", "token_count")


def _texts(spark, sf_dir) -> DataFrame:
    return spread(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).filter("text is not null")


def src03_markdown_sections(spark, sf_dir):
    return markdown_sections(_texts(spark, sf_dir), "doc_id", "text").select("doc_id", "section_no", "level", "heading", F.length("text").alias("n_chars"))


def src06_html_sections(spark, sf_dir):
    return html_sections(_texts(spark, sf_dir).filter(F.col("text").rlike("<h[1-6]>")), "doc_id", "text").select("doc_id", "section_no", "level", "heading", F.length("text").alias("n_chars"))


def chk01_fixed_chunks(spark, sf_dir):
    """Whole texts cut into chunks of 64 words with an overlap of 16."""
    docs = _texts(spark, sf_dir).withColumn("section_no", F.lit(1))
    return chunk_sections(docs, "doc_id", 64, 16, 10).select("doc_id", "chunk_index", "token_count", F.md5("chunk_text").alias("digest"))


def sections_or_whole(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, section_no, anchor, text: the sections of Markdown texts; a text without a heading is one section, number 0."""
    cut = markdown_sections(docs, id_col, text_col).select(id_col, "section_no", slugify(F.col("heading")).alias("anchor"), "text")
    plain = docs.filter(~F.col(text_col).rlike(r"(?m)^#{1,6}\s+\S")).select(id_col, F.lit(0).cast("long").alias("section_no"), F.lit(None).cast("string").alias("anchor"), F.col(text_col).alias("text"))
    return cut.unionByName(plain)


def chk02_section_chunks(spark, sf_dir):
    """Texts cut section by section, those without a heading as a whole; the anchor is the heading's, else the chunk's number."""
    s = cut_table(sections_or_whole(_texts(spark, sf_dir), "doc_id", "text"))
    chunks = chunk_sections(s, "doc_id", 64, 16, 10).join(s.select("doc_id", "section_no", "anchor"), ["doc_id", "section_no"])
    anchor = F.coalesce("anchor", F.concat(F.lit("chunk-"), F.col("chunk_index").cast("string")))
    return chunks.select("doc_id", "chunk_index", "section_no", anchor.alias("anchor"), "token_count", F.md5("chunk_text").alias("digest"))


def snk01_upsert_documents(spark, sf_dir):
    """Documents changed in 2025 upserted into the older ones by (source_uri, doc_version)."""
    d = live_documents(spark, sf_dir, "source_uri", "doc_version", "title", "author", "updated_at").withColumn("key", F.concat_ws("|", "source_uri", "doc_version"))
    old = d.filter(F.col("updated_at") < F.lit("2025-01-01").cast("timestamp")).groupBy("key").agg(F.max(F.struct("updated_at", "title", "author")).alias("o"))
    new = d.groupBy("key").agg(F.max(F.struct("updated_at", "title", "author")).alias("n")).filter(F.col("n.updated_at") >= F.lit("2025-01-01").cast("timestamp"))
    j = old.join(new, "key", "full")
    return j.select("key", F.coalesce("n.title", "o.title").alias("title"), F.coalesce("o.author", "n.author").alias("author"), F.col("o").isNotNull().alias("existed"))


def snk02_replace_chunks(spark, sf_dir):
    """Chunks of (doc_id, doc_version) with any change since July 2025 replaced by the changed ones; chunks a document."""
    ck = live_chunks(spark, sf_dir, "doc_id", "doc_version", "chunk_index", "updated_at")
    new = ck.filter(F.col("updated_at") >= F.lit("2025-07-01").cast("timestamp"))
    kept = ck.join(new.select("doc_id", "doc_version").distinct(), ["doc_id", "doc_version"], "left_anti")
    return kept.unionByName(new).groupBy("doc_id", "doc_version").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_index").alias("last_index"))


def snk10_cascade_delete(spark, sf_dir):
    """Rows left in each table after the deleted documents are gone, with all that hangs on them."""
    gone = pick(table(spark, sf_dir, "kb_documents"), "doc_id", "deleted_at").filter("deleted_at is not null").select("doc_id").distinct()
    of_chunk = F.regexp_replace("chunk_id", "_chunk_[0-9]+$", "")
    chunks = pick(table(spark, sf_dir, "kb_chunks"), "chunk_id", "doc_id").distinct().join(gone, "doc_id", "left_anti")
    ent = entity_records(spark, sf_dir).select("entity_id", of_chunk.alias("doc_id"))
    left = ent.join(gone, "doc_id", "left_anti")
    alive = left.select("entity_id").unionByName(pick(table(spark, sf_dir, "kb_entities"), "entity_id")).distinct()
    ends = relation_records(spark, sf_dir).select("record_id", "source_entity_id", "target_entity_id")
    rel = hub_join(ends.join(alive.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi"), alive.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id")
    cache = pick(table(spark, sf_dir, "query_cache"), "cache_key", "source_doc_ids").dropDuplicates(["cache_key"])
    stale = cache.select("cache_key", F.explode("source_doc_ids").alias("doc_id")).join(gone, "doc_id", "left_semi").select("cache_key").distinct()
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
    return count("kb_chunks", chunks).unionByName(count("extracted_entities", left)).unionByName(count("extracted_relations", rel)).unionByName(count("query_cache", cache.join(stale, "cache_key", "left_anti")))


def snk13_embedding_texts(spark, sf_dir):
    """Texts to embed again, cut at 30,000 characters, each once a kind: of chunks the text, of entities the name and
    description, of relations the type and evidence. Rows changed since July 2025 were done before."""
    todo = lambda df, at: df.filter(F.col(at) < F.lit("2025-07-01").cast("timestamp"))
    both = lambda a, b: F.concat(F.col(a), F.lit(" "), F.coalesce(b, F.lit("")))
    ck = todo(live_chunks(spark, sf_dir, "chunk_text", "updated_at"), "updated_at").select(F.lit("chunk").alias("kind"), F.col("chunk_text").alias("t"))
    en = todo(entity_records(spark, sf_dir), "updated_at").select(F.lit("entity").alias("kind"), both("name", "description").alias("t"))
    rl = todo(relation_records(spark, sf_dir), "created_at").select(F.lit("relation").alias("kind"), both("type", "evidence").alias("t"))
    every = ck.unionByName(en).unionByName(rl).filter("t is not null").withColumn("t", F.left("t", F.lit(30000)))
    return every.groupBy("kind", F.md5("t").alias("digest")).agg(F.count(F.lit(1)).alias("n_records"))


def win05_renumber(spark, sf_dir):
    """Chunks of ten words or more, numbered anew within their document."""
    ck = live_chunks(spark, sf_dir, "doc_id", "chunk_index", "token_count").filter("token_count >= 10")
    return ck.select("chunk_id", "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")) - 1).alias("n"))


def win04_two_per_url(spark, sf_dir):
    ck = live_chunks(spark, sf_dir, "citation_url").withColumn("url", F.regexp_replace("citation_url", "#.*$", "")).filter("url is not null")
    w = Window.partitionBy("url").orderBy(F.md5(F.concat(F.lit("7:"), F.col("chunk_id"))), "chunk_id")
    return ck.withColumn("n", F.row_number().over(w)).filter("n <= 2").select("url", "chunk_id", "n")


_CK = "ck as (select distinct on (chunk_id) * from kb_chunks where deleted_at is null)"
_D = "d as (select distinct on (doc_id) * from kb_documents where deleted_at is null)"
_R = "r as (select distinct on (record_id) * from extracted_entities), rl as (select distinct on (record_id) * from extracted_relations)"
_TRIM = "regexp_replace({0}, '^ +| +$', '', 'g')"
SQL = {
    "src03_markdown_sections": f"with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null), n as (select *, sum(regexp_matches(line, '^#{{1,6}}[ \\t\\n\\f\\r\\x0b]+[^ \\t\\n\\f\\r\\x0b]')::int) over (partition by doc_id order by pos) section_no from l), s as (select doc_id, section_no, list(line order by pos) ls from n where section_no > 0 group by 1, 2) select doc_id, section_no::bigint section_no, length(regexp_extract(ls[1], '^(#+)', 1))::int as level, {_TRIM.format(chr(39).join(['regexp_replace(ls[1], ', '^#+[ \\t\\n\\f\\r\\x0b]+', ', ', '', ')']))} heading, length({_TRIM.format('array_to_string(ls[2:], chr(10))')})::int n_chars from s",
    "snk01_upsert_documents": f"with {_D}, k as (select concat_ws('|', source_uri, doc_version) as \"key\", max({{u: updated_at, t: title, a: author}}) filter (updated_at < timestamptz '2025-01-01 00:00:00+00') o, max({{u: updated_at, t: title, a: author}}) n from d group by 1) select \"key\", case when n.u >= timestamptz '2025-01-01 00:00:00+00' then coalesce(n.t, o.t) else o.t end title, case when n.u >= timestamptz '2025-01-01 00:00:00+00' then coalesce(o.a, n.a) else o.a end author, o is not null existed from k",
    "snk02_replace_chunks": f"with {_CK}, n as (select * from ck where updated_at >= timestamptz '2025-07-01 00:00:00+00') select doc_id, doc_version, count(*) n_chunks, max(chunk_index) last_index from (select * from ck where (doc_id, doc_version) not in (select (doc_id, doc_version) from n) union all select * from n) group by 1, 2",
    "snk10_cascade_delete": f"with {_R}, gone as (select doc_id from kb_documents where deleted_at is not null), l as (select entity_id from r where regexp_replace(chunk_id, '_chunk_[0-9]+$', '') not in (from gone)), alive as (select entity_id from l union select entity_id from kb_entities), q as (select distinct on (cache_key) * from query_cache) select 'kb_chunks' table_name, count(*) n_left from (select distinct chunk_id, doc_id from kb_chunks) where doc_id not in (from gone) union all select 'extracted_entities', count(*) from l union all select 'extracted_relations', count(*) from rl where source_entity_id in (from alive) and target_entity_id in (from alive) union all select 'query_cache', count(*) from q where cache_key not in (select cache_key from (select cache_key, unnest(source_doc_ids) x from q) where x in (from gone))",
    "snk13_embedding_texts": f"with {_R}, {_CK}, t as (select 'chunk' kind, chunk_text t, updated_at u from ck union all select 'entity', name || ' ' || coalesce(description, ''), updated_at from r union all select 'relation', type || ' ' || coalesce(evidence, ''), created_at from rl) select kind, md5(substring(t, 1, 30000)) digest, count(*) n_records from t where t is not null and u < timestamptz '2025-07-01 00:00:00+00' group by 1, 2",
    "win05_renumber": f"with {_CK} select chunk_id, doc_id, (row_number() over (partition by doc_id order by chunk_index, chunk_id) - 1)::int n from ck where token_count >= 10",
    "win04_two_per_url": f"with {_CK} select url, chunk_id, n from (select *, row_number() over (partition by url order by md5('7:' || chunk_id), chunk_id) n from (select chunk_id, regexp_replace(citation_url, '#.*$', '') url from ck where citation_url is not null)) where n <= 2",
}
QUERIES = {f.__name__: f for f in (src03_markdown_sections, src06_html_sections, chk01_fixed_chunks, chk02_section_chunks, snk01_upsert_documents, snk02_replace_chunks, snk10_cascade_delete, snk13_embedding_texts, win05_renumber, win04_two_per_url)}
