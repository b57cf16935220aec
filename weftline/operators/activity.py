"""The answer cache, the log of events, conversations and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import dense_topk, finite
from weftline.operators.graph import entity_records
from weftline.operators.retrieval import DIM, query_set
from weftline.session import pick, table

#: The time at which the queries of the cache are asked, so that results do not change with the clock.
NOW, TTL_DAYS = "2026-01-01 00:00:00", 365


def cache_rows(spark, sf_dir, *cols: str) -> DataFrame:
    return pick(table(spark, sf_dir, "query_cache"), *dict.fromkeys(["cache_key", *cols])).dropDuplicates(["cache_key"])


def _fresh(days: int):
    return F.col("created_at") > F.lit(NOW).cast("timestamp") - F.expr(f"interval {days} days")


def top03_cache_lookup(spark, sf_dir):
    """The most similar other cached question of each query vector within the time to live; hit from 0.95 on."""
    rows = cache_rows(spark, sf_dir, "query_embedding", "created_at").filter(_fresh(TTL_DAYS)).select(F.col("cache_key").alias("id"), F.col("query_embedding").alias("vec")).filter(finite(F.col("vec"), DIM))
    asked = query_set(spark, sf_dir).select("qid", "vec").filter(finite(F.col("vec"), DIM))
    return dense_topk(asked, rows, 1, other=True).select("qid", F.col("id").alias("cache_key"), "sim", (F.col("sim") >= 0.95).alias("hit"))


def dat01_expired(spark, sf_dir):
    """Cached answers by month of creation: how many are past a life of 200 days."""
    c = cache_rows(spark, sf_dir, "created_at")
    return c.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~_fresh(200)).alias("n_expired"))


def stm06_cache_after_hits(spark, sf_dir):
    """The cache after every graph context asked its query once: hit counts and times of access merged in."""
    asked = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "query", "created_at").dropDuplicates(["context_id"]).groupBy(F.lower(F.trim("query")).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("at"))
    c = cache_rows(spark, sf_dir, "query_original", "hit_count", "accessed_at").withColumn("q", F.lower(F.trim("query_original")))
    j = c.join(asked, "q", "left")
    return j.select("cache_key", (F.coalesce("hit_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("hit_count"), F.greatest("accessed_at", "at").alias("accessed_at"))


def _events(spark, sf_dir) -> DataFrame:
    return pick(table(spark, sf_dir, "events"), "event_id", "ts", "user_id", "event_type", "value", "props").dropDuplicates(["event_id"])


def snk09_latest_run(spark, sf_dir):
    """A log of runs by user: the last of the events that end one (purchase or error), else running."""
    e = _events(spark, sf_dir)
    last = F.max(F.when(F.col("event_type").isin("purchase", "error"), F.struct("ts", "event_id", "event_type")))
    return e.groupBy("user_id").agg(last.alias("l"), F.min("ts").alias("started_at")).select("user_id", "started_at", F.when(F.col("l.event_type") == "purchase", "succeeded").when(F.col("l.event_type") == "error", "failed").otherwise("running").alias("status"))


def win08_relative_time(spark, sf_dir):
    """Seconds of each event since the first one of its user."""
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return _events(spark, sf_dir).select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(first.cast("timestamp")) / 1e6, 3).alias("seconds_"))


def win09_message_buffer(spark, sf_dir):
    """A user with more than ten messages keeps the last five, the others go into the summary."""
    w = Window.partitionBy("user_id")
    e = _events(spark, sf_dir).withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).withColumn("n", F.count(F.lit(1)).over(w))
    return e.filter((F.col("n") <= 10) | (F.col("back") <= 5)).groupBy("user_id", "n").agg(F.sort_array(F.collect_list("event_id")).alias("kept")).select("user_id", F.array_join("kept", ",").alias("kept"), F.when(F.col("n") > 10, F.col("n") - 5).otherwise(0).alias("n_summarised"))


def agg23_paths(spark, sf_dir):
    """Kinds of event of each user in order of their first appearance, as a path."""
    first = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), " -> ").alias("path"))


def win_tumbling_hours(spark, sf_dir):
    """Events and their values by hour and kind."""
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def agg15_summary(spark, sf_dir):
    """Lengths of prompts and references: overall, by category and by kind of id."""
    a = pick(table(spark, sf_dir, "agent_eval_example"), "id", "prompt", "reference", "metadata").dropDuplicates(["id"]).select(F.coalesce("metadata.category", F.lit("none")).alias("category"), F.split_part("id", F.lit("-"), F.lit(1)).alias("kind"), F.length("prompt").alias("p"), F.length("reference").alias("r"))
    return a.groupingSets([[], [F.col("category")], [F.col("kind")]], F.col("category"), F.col("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("prompt_chars"), F.round(F.avg("r"), 4).alias("reference_chars"))


def agg16_mean_without_nan(spark, sf_dir):
    return entity_records(spark, sf_dir).groupBy("type").agg(F.round(F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))), 6).alias("mean_confidence"), F.count_if(F.isnan("confidence") | F.col("confidence").isNull()).alias("n_without"))


def agg18_graph_metrics(spark, sf_dir):
    """Of each graph context: depth (0 nothing, 1 entities, 2 relations too) and number of different documents."""
    c = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "entities", "relations", "source_chunk_ids").dropDuplicates(["context_id"])
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    docs = F.array_distinct(F.transform(F.filter("source_chunk_ids", lambda s: s.isNotNull() & (F.trim(s) != "")), lambda s: F.split_part(F.trim(s), F.lit("_chunk_"), F.lit(1))))
    return c.select("context_id", F.when(size("relations") > 0, 2).when(size("entities") > 0, 1).otherwise(0).alias("depth"), size(docs).alias("n_docs"))


def set01_merged_contexts(spark, sf_dir):
    """Entities and relation ends of the contexts of one query text, united without repeats."""
    c = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "query", "entities", "relations").dropDuplicates(["context_id"])
    a = c.select("query", F.inline("entities")).select("query", "name")
    r = c.select("query", F.inline("relations"))
    every = a.unionByName(r.select("query", F.col("source_entity").alias("name"))).unionByName(r.select("query", F.col("target_entity").alias("name")))
    return every.filter("name is not null and trim(name) <> ''").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n_names"))


def arr02_all_any(spark, sf_dir):
    """Records all of whose chunks, or any of whose chunks, belong to the document with most chunks."""
    ck = pick(table(spark, sf_dir, "kb_chunks"), "chunk_id", "doc_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_id").limit(1).select(F.col("doc_id").alias("big"))
    r = entity_records(spark, sf_dir).crossJoin(F.broadcast(ck))
    own = lambda x: F.coalesce(x.startswith(F.col("big")), F.lit(False))
    return r.select(F.when(F.forall("source_chunk_ids", own), "all").when(F.exists("source_chunk_ids", own), "any").otherwise("none").alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("n"))


_C = "c as (select distinct on (cache_key) * from query_cache)"
_E = "e as (select distinct on (event_id) * from events)"
_G = "g as (select distinct on (context_id) * from graph_contexts)"
_OK = "{0} is not null and len({0}) = 64 and len(list_filter({0}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({0}, lambda x: x <> 0)) > 0"
_NOW = "timestamptz '2026-01-01 00:00:00+00'"
SQL = {
    "top03_cache_lookup": f"with {_C}, q as (select cache_key qid, query_embedding qv from c where ('0x' || left(cache_key, 8))::bigint % 20 = 0 and {_OK.format('query_embedding')}), r as (select cache_key, query_embedding v from c where created_at > {_NOW} - interval 365 day and {_OK.format('query_embedding')}) select qid, cache_key, sim, sim >= 0.95 hit from (select *, row_number() over (partition by qid order by sim desc, cache_key) n from (select qid, cache_key, round(list_cosine_similarity(qv::double[], v::double[]), 6) sim from q, r where qid <> cache_key)) where n = 1",
    "dat01_expired": f"with {_C} select strftime(created_at, '%Y-%m') as month, count(*) n, count(*) filter (not created_at > {_NOW} - interval 200 day) n_expired from c group by 1",
    "stm06_cache_after_hits": f"with {_C}, {_G}, a as (select lower(trim(query)) q, count(*) n, max(created_at) at_ from g group by 1) select cache_key, coalesce(hit_count, 0) + coalesce(n, 0) hit_count, greatest(accessed_at, at_) accessed_at from c left join a on a.q = lower(trim(query_original))",
    "snk09_latest_run": f"with {_E} select user_id, min(ts) started_at, case arg_max(event_type, (ts, event_id)) filter (event_type in ('purchase', 'error')) when 'purchase' then 'succeeded' when 'error' then 'failed' else 'running' end status from e group by 1",
    "win08_relative_time": f"with {_E} select event_id, round((epoch_us(ts) / 1e6 - epoch_us(min(ts) over (partition by user_id)) / 1e6), 3) as seconds_ from e",
    "win09_message_buffer": f"with {_E}, n as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) back, count(*) over (partition by user_id) n from e) select user_id, string_agg(event_id::varchar, ',' order by event_id) kept, case when n > 10 then n - 5 else 0 end n_summarised from n where n <= 10 or back <= 5 group by user_id, n",
    "agg23_paths": f"with {_E} select user_id, string_agg(event_type, ' -> ' order by at_, id_) path from (select user_id, event_type, min(ts) at_, arg_min(event_id, (ts, event_id)) id_ from e group by 1, 2) group by 1",
    "win_tumbling_hours": f"with {_E} select date_trunc('hour', ts) as hour, event_type, count(*) n, round(sum(value), 4) total from e group by 1, 2",
    "agg15_summary": "with a as (select coalesce(metadata.category, 'none') category, split_part(id, '-', 1) kind, length(prompt) p, length(reference) r from (select distinct on (id) * from agent_eval_example)) select category, kind, count(*) n, round(avg(p), 4) prompt_chars, round(avg(r), 4) reference_chars from a group by grouping sets ((), (category), (kind))",
    "agg16_mean_without_nan": "select type, round(avg(confidence) filter (not isnan(confidence)), 6) mean_confidence, count(*) filter (confidence is null or isnan(confidence)) n_without from (select distinct on (record_id) * from extracted_entities) group by 1",
    "agg18_graph_metrics": f"with {_G} select context_id, case when coalesce(len(relations), 0) > 0 then 2 when coalesce(len(entities), 0) > 0 then 1 else 0 end depth, coalesce(len(list_distinct(list_transform(list_filter(source_chunk_ids, lambda s: s is not null and trim(s) <> ''), lambda s: split_part(trim(s), '_chunk_', 1)))), 0)::int n_docs from g",
    "set01_merged_contexts": f"with {_G}, x as (select query, unnest(entities).name n from g union select query, unnest(relations).source_entity from g union select query, unnest(relations).target_entity from g) select query, count(*) n_names from x where n is not null and trim(n) <> '' group by 1",
    "arr02_all_any": "with b as (select doc_id big from (select distinct chunk_id, doc_id from kb_chunks) group by 1 order by count(*) desc, doc_id limit 1), r as (select distinct on (record_id) * from extracted_entities), h as (select len(source_chunk_ids) n, len(list_filter(source_chunk_ids, lambda x: x is not null and starts_with(x, big))) k from r, b) select case when n = k then 'all' when k > 0 then 'any' else 'none' end held, count(*) n from h group by 1",
}
QUERIES = {n: globals()[n] for n in SQL}
