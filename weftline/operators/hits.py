"""Shapes of hits, look-ups, re-ranking and graph retrieval by derived vectors."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.functions.vectors import cosine, dense_topk, finite
from weftline.operators.context import context_queries, mentions, name_keys
from weftline.operators.graph import edges, entity_records, relation_records
from weftline.operators.retrieval import DIM, context_chunks, dense, lex03_bm25, live_chunks, live_documents, query_set, terms
from weftline.operators.skew import hub_join
from weftline.session import cut_table, pick, table

CITATION = ["citation_url", "citation_title", "citation_year", "citation_month", "page_start", "page_end", "section_id", "anchor_id"]


def hits(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, chunk_text, citation: the locators of a chunk in one nested field."""
    short = lambda c: c.removeprefix("citation_")
    return chunks.select("chunk_id", "doc_id", "chunk_text", F.struct(*[F.col(c).alias(short(c)) for c in CITATION]).alias("citation"))


def prj01_hits(spark, sf_dir):
    """Chunks as hits, their nested citation read back."""
    h = hits(live_chunks(spark, sf_dir, "doc_id", "chunk_text", *CITATION))
    return h.select("chunk_id", "doc_id", F.length("chunk_text").alias("n_chars"), "citation.url", "citation.year", "citation.month", "citation.page_start", "citation.section_id")


def fil04_nested_or_flat(spark, sf_dir):
    """Chunks of the years 2018 to 2022 by the nested field of the metadata, or by the flat one where that is missing."""
    ck = live_chunks(spark, sf_dir, "metadata", "citation_year", "citation_month")
    nested = lambda k: F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", "string").try_cast("int")
    year, month = F.coalesce(nested("year"), F.col("citation_year")), F.coalesce(nested("month"), F.col("citation_month"))
    return ck.filter(year.between(2018, 2022) & (month <= 6)).select("chunk_id", year.alias("year"), month.alias("month"))


def prj05_lookups(spark, sf_dir):
    """Extracted entities looked up by (lower name, type) of every shared entity; the smallest id of equal names."""
    want = pick(table(spark, sf_dir, "kb_entities"), "entity_id", "name", "type").distinct().select(F.col("entity_id").alias("asked"), F.lower("name").alias("n"), "type")
    have = entity_records(spark, sf_dir).select(F.lower("name").alias("n"), "type", "entity_id").distinct()
    return want.join(have, ["n", "type"], "left").groupBy("asked").agg(F.min("entity_id").alias("entity_id"), F.count("entity_id").alias("n_ids"))


def prj06_chunks_by_ids(spark, sf_dir):
    """The chunks that each graph context names, each once, with score 0; unknown ids are skipped."""
    return context_chunks(spark, sf_dir).select("qid", F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"))


def top05_rerank(spark, sf_dir):
    """The first 20 lexical hits of each query ordered anew by the cosine of its vector (0 where a hit has none), equal ones by their former rank; best 8."""
    first = lex03_bm25(spark, sf_dir).filter("rank <= 20").select("qid", "id", F.col("rank").alias("former"))
    q = query_set(spark, sf_dir).select("qid", "vec")
    v = live_chunks(spark, sf_dir, "embedding").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("chunk_vec"))
    usable = lambda c: F.when(finite(F.col(c), DIM), F.col(c))
    scored = first.join(q, "qid").join(v, "id").select("qid", "id", "former", F.coalesce(F.round(cosine(usable("vec"), usable("chunk_vec")), 6), F.lit(0.0)).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "former")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 8")


def jon14_expected_names(spark, sf_dir):
    """For each graph context, the ends of its relations of which some entity's name holds them or is held by them."""
    c = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "entities", "relations").dropDuplicates(["context_id"])
    low = lambda arr, f: F.filter(F.transform(F.coalesce(arr, F.array()), lambda x: F.lower(F.trim(x[f]))), lambda x: x.isNotNull() & (x != ""))
    c = c.filter(F.coalesce(F.size("relations"), F.lit(0)) > 0).select("context_id", low(F.col("entities"), "name").alias("have"), F.array_distinct(low(F.col("relations"), "source_entity")).alias("want"))
    found = F.filter("want", lambda w: F.exists("have", lambda h: F.contains(h, w) | F.contains(w, h)))
    return c.select("context_id", F.size("want").alias("n_expected"), F.size(found).alias("n_found"))


def set03_conditional_union(spark, sf_dir):
    """Dense hits put behind the lexical ones where the best lexical score is below 20 (without removing repeats), in their place where
    there is no lexical hit, and left out elsewhere."""
    lex = cut_table(lex03_bm25(spark, sf_dir).filter("rank <= 10"))
    best = query_set(spark, sf_dir).select("qid").join(lex.groupBy("qid").agg(F.max("score").alias("best")), "qid", "left")
    more = best.filter("best is null or best < 20").select("qid")
    den = dense(spark, sf_dir, 10).join(more, "qid", "left_semi").select("qid", "id", "rank", F.lit("dense").alias("source"))
    return lex.select("qid", "id", "rank", F.lit("lexical").alias("source")).unionByName(den)


def str11_prompt_hints(spark, sf_dir):
    """Hints in prompts: what stands after `titled` and `by`, and how many words of four letters or more the reference shares."""
    a = pick(table(spark, sf_dir, "agent_eval_example"), "id", "prompt", "reference").dropDuplicates(["id"])
    long = lambda c: F.filter(terms(c), lambda t: F.length(t) >= 4)
    hint = lambda pat: F.regexp_extract(F.coalesce("prompt", F.lit("")), pat, 1)
    return a.select("id", hint(r"titled ([^?.,]+)").alias("title"), hint(r" by ([A-Z][A-Za-z]+)").alias("writer"), F.size(F.array_intersect(long("prompt"), long("reference"))).alias("n_shared"))


def snk15_report(spark, sf_dir):
    """A Markdown table of the types of entities: line number and line."""
    n = entity_records(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    body = n.select((F.row_number().over(Window.orderBy(F.desc("n"), "type")) + 2).alias("line_no"), F.format_string("| %s | %d |", F.col("type"), F.col("n")).alias("line"))  # as many rows as there are types
    head = spark.range(2).select((F.col("id") + 1).cast("int").alias("line_no"), F.when(F.col("id") == 0, "| type | n |").otherwise("|---|---|").alias("line"))
    return head.unionByName(body)


@pandas_udf(T.ArrayType(T.StringType()))
def json_values(texts: pd.Series) -> pd.Series:
    """The objects and arrays of a text that holds several JSON values one after the other, with anything between them; what
    is broken is passed over up to the next opening bracket."""
    decoder = json.JSONDecoder()

    def one(text: str | None) -> list[str] | None:
        if not isinstance(text, str):
            return None
        out, at = [], 0
        while m := re.compile(r"[{\[]").search(text, at):
            try:
                value, at = decoder.raw_decode(text, m.start())
                out.append(json.dumps(value, ensure_ascii=False))
            except (json.JSONDecodeError, RecursionError):
                at = m.start() + 1
        return out

    return pd.Series([one(t) for t in texts], dtype="object")


def src16_concatenated_json(spark, sf_dir):
    """Metadata and citations of documents and answers written one after the other and read again: number of values."""
    d = live_documents(spark, sf_dir, "metadata", "source_type").select("doc_id", F.concat(F.coalesce("metadata", F.lit("")), F.lit(" -- "), F.to_json(F.struct("source_type"))).alias("text"))
    return d.select("doc_id", F.size(json_values("text")).alias("n_values"))


def derived_vectors(spark, rows: DataFrame, key: str, sf_dir: str) -> DataFrame:
    """key, vec: mean vector of the usable chunks that the records of a key come from. rows: key, source_chunk_ids. Sums of all
    places are gathered on the map side; no vector list is collected."""
    ck = live_chunks(spark, sf_dir, "doc_id", "chunk_index", "embedding").filter(finite(F.col("embedding"), DIM))
    vec = ck.select(F.concat(F.lower("doc_id"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("ref"), "embedding").dropDuplicates(["ref"])
    refs = rows.select(key, F.explode("source_chunk_ids").alias("ref")).select(key, F.lower(F.trim("ref")).alias("ref")).filter("ref <> ''").distinct()
    means = refs.join(vec, "ref").groupBy(key).agg(*[F.round(F.avg(F.col("embedding")[i].cast("double")), 9).alias(f"v{i}") for i in range(DIM)])
    return means.select(key, F.array(*[F.col(f"v{i}") for i in range(DIM)]).alias("vec")).filter(finite(F.col("vec"), DIM))


def _global(spark, sf_dir, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = query_set(spark, sf_dir).select("qid", "vec").filter(finite(F.col("vec"), DIM))
    of = lambda rows, key: cut_table(derived_vectors(spark, rows, key, sf_dir).withColumnRenamed(key, "id"))
    ent = dense_topk(q, of(entity_records(spark, sf_dir).filter("entity_id is not null"), "entity_id"), k)
    rel = dense_topk(q, of(relation_records(spark, sf_dir).filter("relation_id is not null"), "relation_id"), k)
    return q, ent, rel


def top02_entity_vectors(spark, sf_dir):
    """The ten entities and the ten relations nearest to each query."""
    _, ent, rel = _global(spark, sf_dir)
    return ent.withColumn("kind", F.lit("entity")).unionByName(rel.withColumn("kind", F.lit("relation"))).select("qid", "kind", "id", "sim", "rank")


def grf02_global(spark, sf_dir):
    """Global retrieval: entities by vector and by mention (the better score of both), relations by vector."""
    _, ent, rel = _global(spark, sf_dir)
    said = mentions(query_set(spark, sf_dir).select("qid", "query"), name_keys(spark, sf_dir)).select("qid", F.col("entity_id").alias("id"), F.round(1 - F.col("distance"), 6).alias("score"))
    both = ent.select("qid", "id", F.col("sim").alias("score")).unionByName(said).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return both.select("qid", F.lit("entity").alias("kind"), "id", "score").unionByName(rel.select("qid", F.lit("relation").alias("kind"), "id", F.col("sim").alias("score")))


def grf03_hybrid(spark, sf_dir):
    """Union of local and global retrieval: the entities of both, neighbours by one edge with score 0; the best score counts."""
    found = cut_table(grf02_global(spark, sf_dir))
    seeds = found.filter("kind = 'entity'").select("qid", F.col("id").alias("u"))
    e = edges(spark, sf_dir)
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = seeds.join(both, "u").select("qid", F.lit("entity").alias("kind"), F.col("v").alias("id"), F.lit(0.0).alias("score"))
    return found.unionByName(near).groupBy("qid", "kind", "id").agg(F.max("score").alias("score"))


def grf04_name_search(spark, sf_dir):
    """Entities scored by the words that their names share with a context's query, each word by its rarity; best 10."""
    keys = name_keys(spark, sf_dir).filter("alias = 0").select("entity_id", F.explode(F.array_distinct(F.split("key", " "))).alias("term")).distinct()
    n = keys.agg(F.countDistinct("entity_id").alias("n"))
    idf = keys.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    q = context_queries(spark, sf_dir).filter("qid % 20 = 0").select("qid", F.explode(F.array_distinct(terms("query"))).alias("term")).join(idf, "term")
    s = hub_join(cut_table(keys), idf.select("term"), "term").join(q, "term").groupBy("qid", "entity_id").agg(F.round(F.sum("idf"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "entity_id")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


def _sql() -> dict[str, str]:
    from weftline.operators import context as C
    from weftline.operators import retrieval as R

    nested = lambda k: f"try_cast(case when json_valid(metadata) then json_extract_string(metadata, '$.{k}') end as int)"
    vecs = lambda key, rel: f"select {key} id, list(m order by pos) vec from (select {key}, pos, round(avg(x::double), 9) m from (select {key}, unnest(v) x, generate_subscripts(v, 1) pos from (select distinct {key}, lower(trim(ref)) ref from (select {key}, unnest(source_chunk_ids) ref from {rel} where {key} is not null) where trim(ref) <> '') join cv using (ref)) group by 1, 2) group by 1"
    top = lambda kind, src: f"select qid, '{kind}' kind, id, sim, rank from (select *, row_number() over (partition by qid order by sim desc, id) rank from (select qid, id, round(list_cosine_similarity(qv::double[], vec), 6) sim from dq, {src})) where rank <= 10"
    vec = f"""{R._CK}, {R._Q}, dq as (select qid, qv from q where {R._OK.format('qv')}), cv as (select distinct on (ref) lower(doc_id) || '_chunk_' || chunk_index ref, embedding v from ck where {R._OK.format('embedding')}),
      r as (select distinct on (record_id) * from extracted_entities), rl as (select distinct on (record_id) * from extracted_relations), ev as ({vecs('entity_id', 'r')}), rv as ({vecs('relation_id', 'rl')}), tops as ({top('entity', 'ev')} union all {top('relation', 'rv')})"""
    rl = "rl as (select distinct on (record_id) * from extracted_relations), "
    glob = f"gl as (select qid, 'entity' kind, id, max(score) score from (select qid, id, sim score from tops where kind = 'entity' union all select qid, entity_id, round(1 - distance, 6) from men) group by 1, 3 union all select qid, kind, id, sim from tops where kind = 'relation')"
    men = C._MEN
    kb = C._ENT.removeprefix(C._R + ", ")
    ed = C._ED.removeprefix(rl)
    return {
        "prj01_hits": f"with {R._CK} select chunk_id, doc_id, length(chunk_text)::int n_chars, citation_url url, citation_year as year, citation_month as month, page_start, section_id from ck",
        "fil04_nested_or_flat": f"with {R._CK} select * from (select chunk_id, coalesce({nested('year')}, citation_year) as year, coalesce({nested('month')}, citation_month) as month from ck) where year between 2018 and 2022 and month <= 6",
        "prj05_lookups": "select k.entity_id asked, min(e.entity_id) entity_id, count(distinct e.entity_id) n_ids from (select distinct entity_id, name, type from kb_entities) k left join extracted_entities e on lower(e.name) = lower(k.name) and e.type = k.type group by 1",
        "prj06_chunks_by_ids": f"with {R._CK}, {R._CTX} select qid, id chunk_id, 0.0::double score from cc",
        "top05_rerank": f"{R._LEX}, s as (select l.qid, l.id, l.rank former, coalesce(round(case when {R._OK.format('q.qv')} and {R._OK.format('ck.embedding')} then list_cosine_similarity(q.qv::double[], ck.embedding::double[]) end, 6), 0) score from lex l join q on q.qid = l.qid join ck on ck.chunk_id = l.id where l.rank <= 20) select qid, id, former, score, rank from (select *, row_number() over (partition by qid order by score desc, former) rank from s) where rank <= 8",
        "jon14_expected_names": "with c as (select distinct on (context_id) * from graph_contexts where len(relations) > 0), h as (select context_id, lower(trim(e.name)) n from (select context_id, unnest(entities) e from c)), w as (select distinct context_id, lower(trim(e.source_entity)) n from (select context_id, unnest(relations) e from c)) select c.context_id, (select count(*) from w where w.context_id = c.context_id and n <> '')::int n_expected, (select count(distinct w.n) from w join h on h.context_id = w.context_id where w.context_id = c.context_id and w.n <> '' and h.n <> '' and (contains(h.n, w.n) or contains(w.n, h.n)))::int n_found from c",
        "set03_conditional_union": f"{R._LEX}, {R._DENSE}, l as (select * from lex where rank <= 10), b as (select q.qid, max(score) best from q left join l using (qid) group by 1) select qid, id, rank, 'lexical' source from l union all select qid, id, rank, 'dense' from dn where rank <= 10 and qid in (select qid from b where best is null or best < 20)",
        "str11_prompt_hints": f"select id, regexp_extract(coalesce(prompt, ''), 'titled ([^?.,]+)', 1) title, regexp_extract(coalesce(prompt, ''), ' by ([A-Z][A-Za-z]+)', 1) writer, len(list_intersect(list_distinct(list_filter({R._TERMS.format('prompt')}, lambda t: length(t) >= 4)), list_distinct(list_filter({R._TERMS.format('reference')}, lambda t: length(t) >= 4))))::int n_shared from (select distinct on (id) * from agent_eval_example)",
        "snk15_report": "select 1 line_no, '| type | n |' line union all select 2, '|---|---|' union all select (row_number() over (order by n desc, type) + 2)::int, '| ' || type || ' | ' || n || ' |' from (select type, count(distinct record_id) n from extracted_entities group by 1)",
        "src16_concatenated_json": "select doc_id, (1 + case when json_valid(metadata) and left(trim(metadata), 1) in ('{', '[') then 1 else 0 end)::int n_values from (select distinct on (doc_id) * from kb_documents where deleted_at is null)",
        "top02_entity_vectors": f"with {vec} select qid, kind, id, sim, rank from tops",
        "grf02_global": f"with {vec}, {men}, {glob} select * from gl",
        "grf03_hybrid": f"with {vec}, {men}, {glob}, {kb}, {ed} select qid, kind, id, max(score) score from (select * from gl union all select qid, 'entity', b.v, 0.0 from gl join b on b.u = gl.id where kind = 'entity') group by 1, 2, 3",
        "grf04_name_search": f"with r as (select distinct on (record_id) * from extracted_entities), said as (select entity_id, name said from r union select entity_id, name from kb_entities), k as (select distinct entity_id, unnest({R._TERMS.format('said')}) term from said where length(array_to_string({R._TERMS.format('said')}, ' ')) >= 2), n as (select count(distinct entity_id) n from k), i as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from k, n group by term, n), q as (select distinct context_id qid, query from graph_contexts where context_id % 20 = 0), {R._QT} select * from (select *, row_number() over (partition by qid order by score desc, entity_id) rank from (select qid, entity_id, round(sum(idf), 6) score from qt join k using (term) join i using (term) group by 1, 2)) where rank <= 10",
    }


SQL = _sql()
QUERIES = {n: globals()[n] for n in SQL}
