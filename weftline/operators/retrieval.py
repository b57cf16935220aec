"""Lexical, dense and fused retrieval over chunks.

The query set is every cached question whose key, read as a number, is divisible by 20: its text is the lexical query
and its vector the dense one. All chunks are searched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.functions.vectors import best_columns, cosine, dense_topk, finite, found_frame, in_blocks
from weftline.session import cut_table, pick, table

K1, B = 1.2, 0.75
DIM = 64


def live_chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks that are not deleted, each once."""
    cols = list(dict.fromkeys(["chunk_id", *columns]))
    return pick(table(spark, sf_dir, "kb_chunks"), *cols, "deleted_at").filter("deleted_at is null").drop("deleted_at").dropDuplicates(["chunk_id"])


def live_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    cols = list(dict.fromkeys(["doc_id", *columns]))
    return pick(table(spark, sf_dir, "kb_documents"), *cols, "deleted_at").filter("deleted_at is null").drop("deleted_at").dropDuplicates(["doc_id"])


def terms(text: Column | str) -> Column:
    """Words of ASCII letters and digits in lower case, as the simple text search of the data model has them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def asked(key: Column | str) -> Column:
    """Whether a hexadecimal key, read as a number by its first 8 digits, is divisible by 20."""
    return F.conv(F.left(F.col(key) if isinstance(key, str) else key, F.lit(8)), 16, 10).cast("long") % 20 == 0


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query, rewritten, vec."""
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "query_original", "query_rewritten", "query_embedding").filter(asked("cache_key")).dropDuplicates(["cache_key"])
    return q.select(F.col("cache_key").alias("qid"), F.col("query_original").alias("query"), F.col("query_rewritten").alias("rewritten"), F.col("query_embedding").alias("vec"))


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query: the names of the entity records whose id is divisible by 20."""
    return pick(table(spark, sf_dir, "extracted_entities"), "record_id", "name").filter("record_id % 20 = 0").dropDuplicates(["record_id"]).select(F.col("record_id").alias("qid"), F.col("name").alias("query"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, dl: one row a term of a text. Texts without a term are left out."""
    t = docs.select(F.col(id_col).alias("id"), terms(text_col).alias("ts")).withColumn("dl", F.size("ts")).filter("dl > 0")
    return t.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(terms("query"))).alias("term"))


def document_frequencies(texts: DataFrame, field: str) -> DataFrame:
    """term, df. texts: the field is an array of terms."""
    return texts.select(F.explode(F.array_distinct(field)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def and_match(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """qid, id: texts that have every term of the query (no stemming, no stop words). A query without terms matches nothing.

    Queries meet texts by their rarest term only, so common words cost nothing; the other terms are looked up in the
    candidates."""
    texts = docs.select(F.col(id_col).alias("id"), F.array_distinct(terms(text_col)).alias("ts"))
    df = document_frequencies(texts, "ts")
    rare = query_terms(queries).join(df, "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"), F.collect_list("term").alias("all_terms"))
    rare = rare.filter("r.df > 0").select("qid", F.col("r.term").alias("term"), "all_terms")
    ids = texts.select("id", F.explode("ts").alias("term")).join(rare.select("term").distinct(), "term", "left_semi")
    candidates = rare.join(ids, "term").select("qid", "id", "all_terms")
    return candidates.join(texts, "id").filter(F.size(F.array_except("all_terms", "ts")) == 0).select("qid", "id")


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, fields: dict[str, float], k: int = 40, among: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: any term may match; ties by id. The score is the best field's, each times its boost. Document
    frequencies and lengths are those of all texts; `among` (id) restricts which texts may be found.

    Blocks of queries with the weights of their terms meet buckets of texts in groups, which score by sparse rows of one
    term at a time and keep their own best k; a window merges them."""
    names = list(fields)
    texts = docs.select(F.col(id_col).alias("id"), *[terms(f).alias(f) for f in names])
    asked_terms = cut_table(query_terms(queries))
    weights = None
    for f in names:
        stats = texts.filter(F.size(f) > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(f)).alias("avgdl"))
        df = document_frequencies(texts, f).join(asked_terms.select("term").distinct(), "term", "left_semi")
        one = df.crossJoin(F.broadcast(stats)).select("term", F.lit(f).alias("field"), F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
        weights = one if weights is None else weights.unionByName(one)
    per_query = asked_terms.join(weights, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "field", "idf", "avgdl")).alias("ws"))
    rows = texts if among is None else texts.join(among, "id", "left_semi")

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return found_frame([], [], [], "score")
        r = r.sort_values("id", ignore_index=True)
        best = np.zeros((len(q), len(r)))
        for f in names:
            wanted: dict[str, list[tuple[int, float, float]]] = {}
            for i, ws in enumerate(q["ws"]):
                for w in ws:
                    if w["field"] == f:
                        wanted.setdefault(w["term"], []).append((i, w["idf"], w["avgdl"]))
            where: dict[str, dict[int, int]] = {}
            for j, ts in enumerate(r[f]):
                for t in ts:
                    if t in wanted:
                        at = where.setdefault(t, {})
                        at[j] = at.get(j, 0) + 1
            length = np.array([len(ts) for ts in r[f]], np.float64)
            own = np.zeros_like(best)
            for t in sorted(where):
                at = np.fromiter(where[t], np.int64, len(where[t]))
                tf = np.fromiter(where[t].values(), np.float64, len(where[t]))
                who = np.array([i for i, _, _ in wanted[t]])
                _, idf, avgdl = wanted[t][0]
                own[np.ix_(who, at)] += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / avgdl))
            best = np.maximum(best, fields[f] * own)
        at, top = best_columns(np.round(best, 6), k)
        hit = top.ravel() > 0
        return found_frame(np.repeat(q["qid"].to_numpy(), at.shape[1])[hit], r["id"].to_numpy()[at.ravel()][hit], top.ravel()[hit], "score")

    q, r = in_blocks(per_query, rows, "qid", "id")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    found = q.groupBy("_block", "_bucket").cogroup(r.groupBy("_block", "_bucket")).applyInPandas(score, schema)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cover_density(places: list[list[int]]) -> float:
    """places: positions of each query term in the text. Sum over the shortest stretches that hold all terms of 0.1 /
    (1 + words between), where a stretch with more occurrences of terms has fewer words between."""
    if not places or not all(places):
        return 0.0
    at = sorted((p, i) for i, ps in enumerate(places) for p in ps)
    total, last, seen = 0.0, {}, -1
    for k, (p, i) in enumerate(at):
        last[i] = k
        if len(last) < len(places):
            continue
        begin = min(last.values())
        if begin > seen:  # a later end with the same beginning is no shortest stretch
            total += 0.1 / (1 + (p - at[begin][0]) - (k - begin))
            seen = begin
    return total


@pandas_udf(T.DoubleType())
def cover_density_of(text_terms: pd.Series, wanted: pd.Series) -> pd.Series:
    out = []
    for ts, ws in zip(text_terms, wanted):
        at: dict[str, list[int]] = {w: [] for w in ws}
        for i, t in enumerate(ts, 1):
            if t in at:
                at[t].append(i)
        out.append(round(cover_density(list(at.values())), 9))
    return pd.Series(out, dtype="float64")


def dense(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    rows = live_chunks(spark, sf_dir, "embedding").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")).filter(finite(F.col("vec"), DIM))
    return dense_topk(query_set(spark, sf_dir).select("qid", "vec").filter(finite(F.col("vec"), DIM)), rows, k)


#: Fields of the lexical search with their boosts.
FIELDS = {"chunk_text": 3.0, "citation_title": 2.0}


def rrf(lists: list[tuple[DataFrame, float]], k: float, limit: int) -> DataFrame:
    """qid, id, score, rank, sources: reciprocal rank fusion of ranked lists (qid, id, rank) with weights."""
    every = None
    for i, (one, weight) in enumerate(lists):
        part = one.select("qid", "id", (F.lit(weight) / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.lit(1 << i).alias("bit"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"), F.sum("bit").alias("sources"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def lex01_and_match(spark, sf_dir):
    """Chunks with every word of a name."""
    return and_match(name_queries(spark, sf_dir), live_chunks(spark, sf_dir, "chunk_text"), "chunk_id", "chunk_text")


def lex02_cover_density(spark, sf_dir):
    """The chunks of lex01 ranked by cover density; best 40 of each name."""
    q, ck = name_queries(spark, sf_dir), live_chunks(spark, sf_dir, "chunk_text")
    hits = and_match(q, ck, "chunk_id", "chunk_text")
    full = hits.join(q.select("qid", F.array_distinct(terms("query")).alias("ws")), "qid").join(ck.select(F.col("chunk_id").alias("id"), terms("chunk_text").alias("ts")), "id")
    scored = full.select("qid", "id", cover_density_of("ts", "ws").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 40")


def lex03_bm25(spark, sf_dir):
    return bm25(query_set(spark, sf_dir), live_chunks(spark, sf_dir, *FIELDS), "chunk_id", FIELDS)


def src13_filtered_search(spark, sf_dir):
    """The same search among chunks of English crawled documents since 2018 only."""
    keep = pick(table(spark, sf_dir, "kb_documents"), "doc_id", "lang", "source_type", "published_year", "deleted_at").filter("deleted_at is null and lower(lang) = 'en' and source_type = 'crawler' and published_year >= 2018").select("doc_id").distinct()
    ck = live_chunks(spark, sf_dir, "doc_id", *FIELDS)
    return bm25(query_set(spark, sf_dir), ck, "chunk_id", FIELDS, 20, ck.join(keep, "doc_id", "left_semi").select(F.col("chunk_id").alias("id")))


def lex04_rank_score(spark, sf_dir):
    """Rank turned into a score, 1 / (60 + rank)."""
    return lex03_bm25(spark, sf_dir).select("qid", "id", F.round(F.lit(1.0) / (F.lit(60.0) + F.col("rank")), 9).alias("score"))


def win02_dense_rank(spark, sf_dir):
    return dense(spark, sf_dir)


def agg01_rrf(spark, sf_dir):
    """Entry query: lexical and dense candidates of each query, fused; best 8."""
    return rrf([(lex03_bm25(spark, sf_dir), 1.0), (dense(spark, sf_dir), 1.0)], 60, 8)


def jon02_full_outer(spark, sf_dir):
    """The same fusion written as a full outer join of the two candidate lists."""
    s, d = lex03_bm25(spark, sf_dir).select("qid", "id", F.col("rank").alias("rs")), dense(spark, sf_dir).select("qid", "id", F.col("rank").alias("rd"))
    score = F.coalesce(F.lit(1.0) / (60.0 + F.col("rs")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (60.0 + F.col("rd")), F.lit(0.0))
    return s.join(d, ["qid", "id"], "full").select("qid", "id", F.col("rs").alias("sparse_rank"), F.col("rd").alias("dense_rank"), F.round(score, 9).alias("score"))


def context_chunks(spark, sf_dir) -> DataFrame:
    """qid, id, rank: chunk ids of the graph contexts in their order, composite keys led back to chunk ids."""
    ctx = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "source_chunk_ids").dropDuplicates(["context_id"])
    refs = ctx.select(F.col("context_id").alias("qid"), F.posexplode("source_chunk_ids").alias("pos", "ref")).withColumn("ref", F.lower(F.trim("ref"))).filter("ref <> ''")
    ck = live_chunks(spark, sf_dir, "doc_id", "chunk_index")
    keys = ck.select("chunk_id", F.explode(F.array(F.lower("chunk_id"), F.concat(F.lower("doc_id"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))).alias("ref"))
    hit = refs.join(keys, "ref").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.min("pos").alias("pos"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "id"))).drop("pos")


def agg02_weighted_rrf(spark, sf_dir):
    """Graph and traditional candidates of the contexts whose id is divisible by 20 fused with weights 0.6 and 0.4, with
    their provenance."""
    q = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "query").filter("context_id % 20 = 0").dropDuplicates(["context_id"]).select(F.col("context_id").alias("qid"), "query")
    fused = rrf([(bm25(q, live_chunks(spark, sf_dir, *FIELDS), "chunk_id", FIELDS), 0.4), (context_chunks(spark, sf_dir).filter("qid % 20 = 0"), 0.6)], 60, 8)
    names = F.element_at(F.array(F.lit("traditional"), F.lit("graph"), F.lit("traditional+graph")), F.col("sources").cast("int"))
    return fused.select("qid", "id", "score", "rank", names.alias("source"))


def agg03_sub_question_merge(spark, sf_dir):
    """The lists of a question and of its rewritten form merged: 1 / (1 + rank) for the own one, half of that for the other."""
    q, ck = query_set(spark, sf_dir), live_chunks(spark, sf_dir, *FIELDS)
    sub = q.select("qid", F.col("rewritten").alias("query"))
    return rrf([(bm25(q, ck, "chunk_id", FIELDS, 20), 1.0), (bm25(sub, ck, "chunk_id", FIELDS, 20), 0.5)], 1, 10).drop("sources")


def agg04_first_occurrence(spark, sf_dir):
    """Chunk lists of all contexts with one query text, merged in order of the contexts; first ten different chunks."""
    q = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "query").dropDuplicates(["context_id"]).select(F.col("context_id").alias("qid"), "query")
    every = context_chunks(spark, sf_dir).join(q, "qid")
    first = every.groupBy("query", "id").agg(F.min(F.struct("qid", "rank")).alias("at"))
    w = Window.partitionBy("query").orderBy("at", "id")
    return first.withColumn("n", F.row_number().over(w)).filter("n <= 10").select("query", "id", "n")


def jon03_late_materialisation(spark, sf_dir):
    """Payload of the fused ids, joined last."""
    ids = cut_table(agg01_rrf(spark, sf_dir).select("qid", "id", "rank"))
    ck = live_chunks(spark, sf_dir, "doc_id", "chunk_text").withColumnRenamed("chunk_id", "id")
    docs = live_documents(spark, sf_dir, "title", "lang")
    return ids.join(ck, "id").join(docs, "doc_id", "left").select("qid", "id", "rank", "title", "lang", F.substring("chunk_text", 1, 280).alias("snippet"))


def vec01_cosine_by_document(spark, sf_dir):
    """Mean cosine distance of each chunk to the one before it in its document."""
    ck = live_chunks(spark, sf_dir, "doc_id", "chunk_index", "embedding").filter(finite(F.col("embedding"), DIM))
    before = ck.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("embedding").alias("before"))
    return ck.join(before, ["doc_id", "chunk_index"]).groupBy("doc_id").agg(F.round(F.avg(1 - cosine(F.col("embedding"), F.col("before"))), 6).alias("mean_distance"), F.count(F.lit(1)).alias("n_pairs"))


def agg21_vector_mean(spark, sf_dir):
    """Mean vector of the usable chunks of each document, as rows of (doc_id, pos, value)."""
    ck = live_chunks(spark, sf_dir, "doc_id", "embedding").filter(finite(F.col("embedding"), DIM))
    return ck.select("doc_id", F.posexplode("embedding").alias("pos", "x")).groupBy("doc_id", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


_CK = "ck as (select distinct on (chunk_id) * from kb_chunks where deleted_at is null)"
_HEX = "('0x' || left({0}, 8))::bigint % 20 = 0"
_Q = f"q as (select distinct on (cache_key) cache_key qid, query_original query, query_rewritten rewritten, query_embedding qv from query_cache where {_HEX.format('cache_key')})"
_QG = "q as (select distinct context_id qid, query from graph_contexts where context_id % 20 = 0)"
_QN = "q as (select distinct record_id qid, name query from extracted_entities where record_id % 20 = 0)"
_TERMS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_QT = f"qt as (select distinct qid, unnest({_TERMS.format('query')}) term from q)"


def _field(n: int, col: str) -> str:
    return f"""tok{n} as (select chunk_id id, {_TERMS.format(col)} ts from ck), tk{n} as (select id, len(ts) dl, unnest(ts) term from tok{n} where len(ts) > 0), post{n} as (select id, dl, term, count(*) tf from tk{n} group by all),
  st{n} as (select count(*) n, avg(dl) avgdl from (select distinct id, dl from post{n})), df{n} as (select term, count(*) df from post{n} group by 1)"""


_POST = f"{_field(1, 'chunk_text')}, {_field(2, 'citation_title')}, {_QT}"


def _bm(qt: str, name: str, k: int, among: str = "") -> str:
    part = lambda n, boost: f"select qid, id, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) s from {qt} join df{n} using (term) join post{n} using (term), st{n} group by 1, 2"
    return f"{name} as (select * from (select *, row_number() over (partition by qid order by score desc, id) rank from (select qid, id, round(max(s), 6) score from ({part(1, 3.0)} union all {part(2, 2.0)}) {among} group by 1, 2)) where rank <= {k})"


_LEX = f"with {_CK}, {_Q}, {_POST}, {_bm('qt', 'lex', 40)}"
_OK = "{0} is not null and len({0}) = 64 and len(list_filter({0}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({0}, lambda x: x <> 0)) > 0"
_DENSE = f"dq as (select qid, qv from q where {_OK.format('qv')}), dr as (select chunk_id id, embedding v from ck where {_OK.format('embedding')}), dn as (select * from (select *, row_number() over (partition by qid order by sim desc, id) rank from (select qid, id, round(list_cosine_similarity(qv::double[], v::double[]), 6) sim from dq, dr)) where rank <= 40)"
_RRF = "f as (select qid, id, round(sum(s), 9) score, sum(bit) sources from (select qid, id, 1.0::double / (60 + rank) s, 1 bit from lex union all select qid, id, 1.0::double / (60 + rank), 2 from dn) group by 1, 2), r as (select * from (select *, row_number() over (partition by qid order by score desc, id) rank from f) where rank <= 8)"
_CTX = "refs as (select qid, pos - 1 pos, lower(trim(ref)) ref from (select context_id qid, unnest(source_chunk_ids) ref, generate_subscripts(source_chunk_ids, 1) pos from (select distinct on (context_id) * from graph_contexts)) where trim(ref) <> ''), keys as (select chunk_id id, lower(chunk_id) ref from ck union all select chunk_id, lower(doc_id) || '_chunk_' || chunk_index from ck), cc as (select qid, id, row_number() over (partition by qid order by pos, id) rank from (select qid, id, min(pos) pos from refs join keys using (ref) group by 1, 2))"

SQL = {
    "lex01_and_match": f"with {_CK}, {_QN}, {_QT}, {_field(1, 'chunk_text')} select qid, id from (select qid, id, count(*) has from qt join post1 using (term) group by 1, 2) join (select qid, count(*) need from qt group by 1) using (qid) where has = need",
    "src13_filtered_search": f"with {_CK}, {_Q}, {_POST}, {_bm('qt', 'lex', 20, "where id in (select chunk_id from ck where doc_id in (select doc_id from kb_documents where deleted_at is null and lower(lang) = 'en' and source_type = 'crawler' and published_year >= 2018))")} select qid, id, score, rank from lex",
    "lex03_bm25": _LEX + " select qid, id, score, rank from lex",
    "lex04_rank_score": _LEX + " select qid, id, round(1.0::double / (60 + rank), 9) score from lex",
    "win02_dense_rank": f"with {_CK}, {_Q}, {_DENSE} select qid, id, sim, rank from dn",
    "agg01_rrf": f"{_LEX}, {_DENSE}, {_RRF} select qid, id, score, rank, sources from r",
    "jon02_full_outer": f"{_LEX}, {_DENSE} select coalesce(l.qid, d.qid) qid, coalesce(l.id, d.id) id, l.rank sparse_rank, d.rank dense_rank, round(coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0), 9) score from lex l full join dn d on l.qid = d.qid and l.id = d.id",
    "agg02_weighted_rrf": f"with {_CK}, {_QG}, {_POST}, {_bm('qt', 'lex', 40)}, {_CTX}, f as (select qid, id, round(sum(s), 9) score, sum(bit) sources from (select qid, id, 0.4::double / (60 + rank) s, 1 bit from lex union all select qid, id, 0.6::double / (60 + rank), 2 from cc where qid % 20 = 0) group by 1, 2) select qid, id, score, rank, case sources when 1 then 'traditional' when 2 then 'graph' else 'traditional+graph' end source from (select *, row_number() over (partition by qid order by score desc, id) rank from f) where rank <= 8",
    "agg03_sub_question_merge": f"with {_CK}, {_Q}, {_POST}, qt2 as (select distinct qid, unnest({_TERMS.format('rewritten')}) term from q), {_bm('qt', 'a', 20)}, {_bm('qt2', 'b', 20)}, f as (select qid, id, round(sum(s), 9) score from (select qid, id, 1.0::double / (1 + rank) s from a union all select qid, id, 0.5::double / (1 + rank) from b) group by 1, 2) select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) rank from f) where rank <= 10",
    "agg04_first_occurrence": f"with {_CK}, {_CTX}, e as (select query, id, min((qid, rank)) a1 from cc join (select distinct context_id qid, query from graph_contexts) using (qid) where query is not null group by 1, 2 union all select query, id, min((qid, rank)) a1 from cc join (select distinct context_id qid, query from graph_contexts) using (qid) where query is null group by 1, 2) select query, id, n from (select *, row_number() over (partition by query order by a1, id) n from e) where n <= 10",
    "jon03_late_materialisation": f"{_LEX}, {_DENSE}, {_RRF}, docs as (select distinct on (doc_id) * from kb_documents where deleted_at is null) select qid, id, rank, d.title, d.lang, substring(chunk_text, 1, 280) snippet from r join ck on ck.chunk_id = r.id left join docs d on d.doc_id = ck.doc_id",
    "vec01_cosine_by_document": f"with {_CK}, v as (select doc_id, chunk_index, embedding::double[] e from ck where {_OK.format('embedding')}) select a.doc_id, round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) mean_distance, count(*) n_pairs from v a join v b on a.doc_id = b.doc_id and a.chunk_index = b.chunk_index + 1 group by 1",
    "agg21_vector_mean": f"with {_CK}, v as (select doc_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 pos from ck where {_OK.format('embedding')}) select doc_id, pos::int pos, round(avg(x::double), 6) \"value\" from v group by 1, 2",
}
QUERIES = {f.__name__: f for f in (lex01_and_match, lex02_cover_density, lex03_bm25, src13_filtered_search, lex04_rank_score, win02_dense_rank, agg01_rrf, jon02_full_outer, agg02_weighted_rrf, agg03_sub_question_merge, agg04_first_occurrence, jon03_late_materialisation, vec01_cosine_by_document, agg21_vector_mean)}
