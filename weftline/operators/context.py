"""Mentions, local graph contexts, evidence texts, and checks over metadata and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import edges, entities, entity_records, grf05_edges, label_communities
from weftline.operators.retrieval import context_chunks, live_chunks, live_documents, postings, terms
from weftline.session import pick, table

def name_keys(spark, sf_dir) -> DataFrame:
    """entity_id, key, alias: the words of every name (alias 0) and alias (1) of an entity, of any of its records."""
    every = entity_records(spark, sf_dir).select("entity_id", "name", "aliases").unionByName(pick(table(spark, sf_dir, "kb_entities"), "entity_id", "name", "aliases"))
    said = F.concat(F.array(F.struct(F.col("name").alias("said"), F.lit(0).alias("alias"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("said"), F.lit(1).alias("alias"))))
    return every.select("entity_id", F.inline(said)).select("entity_id", F.array_join(terms("said"), " ").alias("key"), "alias").filter("length(key) >= 2").distinct()


def mentions(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """qid, entity_id, distance: entities whose name or alias occurs in a query as whole words: 0 if the query is the name,
    0.02 if it is an alias, else 0.15; 0.05 where the whole query is a part of a name instead.

    Every run of words of a query, as long as the longest key, is looked up by an equality join, so no query meets
    every name. Keys under two characters and null names never match."""
    runs_of = lambda w, most: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(most, F.size(w) - i)), lambda k: F.array_join(F.slice(w, i + 1, k), " "))))
    longest = keys.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1)).alias("most"))
    asked = queries.select("qid", terms("query").alias("w")).filter("size(w) > 0").withColumn("whole", F.array_join("w", " ")).crossJoin(F.broadcast(longest))
    runs = asked.select("qid", "whole", F.explode(F.array_distinct(runs_of("w", F.col("most")))).alias("key"))
    inside = runs.join(keys, "key").select("qid", "entity_id", F.when(F.col("whole") != F.col("key"), 0.15).when(F.col("alias") == 0, 0.0).otherwise(0.02).alias("distance"))
    wholes = queries.select("qid", F.array_join(terms("query"), " ").alias("part")).filter("length(part) >= 2")
    parts = keys.filter("alias = 0").withColumn("w", F.split("key", " ")).select("entity_id", "key", F.explode(F.array_distinct(runs_of("w", F.size("w")))).alias("part")).filter("part <> key")
    around = wholes.join(parts, "part").select("qid", "entity_id", F.lit(0.05).alias("distance"))
    return inside.unionByName(around).groupBy("qid", "entity_id").agg(F.min("distance").alias("distance"))


def context_queries(spark, sf_dir) -> DataFrame:
    return pick(table(spark, sf_dir, "graph_contexts"), "context_id", "query").dropDuplicates(["context_id"]).select(F.col("context_id").alias("qid"), "query")


def jon05_text_mentions(spark, sf_dir):
    return mentions(context_queries(spark, sf_dir), name_keys(spark, sf_dir))


def top04_mention_order(spark, sf_dir):
    """The mentions of each query by distance, then by the best confidence of the entity."""
    valid = F.when(~F.isnan("confidence") & F.col("confidence").between(0, 1), F.col("confidence"))
    every = entity_records(spark, sf_dir).select("entity_id", "confidence").unionByName(pick(table(spark, sf_dir, "kb_entities"), "entity_id", "confidence"))
    best = every.groupBy("entity_id").agg(F.coalesce(F.max(valid), F.lit(0.0)).alias("confidence"))
    w = Window.partitionBy("qid").orderBy("distance", F.desc("confidence"), "entity_id")
    return jon05_text_mentions(spark, sf_dir).join(best, "entity_id").withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


def grf01_local_context(spark, sf_dir):
    """Entities of the contexts whose id is divisible by 20: those mentioned, and their neighbours by one edge."""
    seeds = mentions(context_queries(spark, sf_dir).filter("qid % 20 = 0"), name_keys(spark, sf_dir)).select("qid", "entity_id")
    e = edges(spark, sf_dir)
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a hub has all its neighbours whichever query names it: a neighbourhood is gathered once and joined to the distinct seeds
    near = seeds.select("qid", F.col("entity_id").alias("u")).join(both.join(seeds.select(F.col("entity_id").alias("u")).distinct(), "u", "left_semi"), "u").select("qid", F.col("v").alias("entity_id"), F.lit(1).alias("role"))
    every = seeds.withColumn("role", F.lit(0)).unionByName(near)
    return every.groupBy("qid", "entity_id").agg(F.min("role").alias("distance"))


def agg07_gleaned_only(spark, sf_dir):
    """Entities that only the second reading found."""
    r = entity_records(spark, sf_dir)
    return r.filter("extractor = 'gleaning'").select("entity_id").distinct().join(r.filter("extractor <> 'gleaning'").select("entity_id").distinct(), "entity_id", "left_anti")


def agg22_rule_scores(spark, sf_dir):
    """Share of the expected titles and writers that the reference names; no row without expectations."""
    a = pick(table(spark, sf_dir, "agent_eval_example"), "id", "reference", "metadata").dropDuplicates(["id"])
    want = F.concat(F.coalesce("metadata.work_search_eval.expected_title_contains", F.array().cast("array<string>")), F.coalesce("metadata.work_search_eval.expected_writer_contains", F.array().cast("array<string>")))
    a = a.select("id", F.lower(F.coalesce("reference", F.lit(""))).alias("text"), F.filter(want, lambda x: x.isNotNull()).alias("want")).filter("size(want) > 0")
    passed = F.size(F.filter("want", lambda x: F.contains(F.col("text"), F.lower(x))))
    return a.select("id", F.size("want").alias("n_checks"), passed.alias("n_passed"), F.round(passed / F.size("want"), 6).alias("score"))


def top09_evidence_names(spark, sf_dir):
    """Names of the ten best entities of each context, best first."""
    c = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "entities").dropDuplicates(["context_id"])
    best = F.slice(F.array_sort(F.transform(F.filter("entities", lambda e: e["name"].isNotNull() & e["score"].isNotNull()), lambda e: F.struct((-e["score"]).alias("s"), e["name"].alias("name")))), 1, 10)
    return c.select("context_id", F.array_join(F.transform(best, lambda e: e["name"]), "; ").alias("names")).filter("names <> ''")


def str09_evidence_blocks(spark, sf_dir):
    """Evidence block of each chunk: title, address, year and month, first 100 characters."""
    ck = live_chunks(spark, sf_dir, "citation_title", "citation_url", "citation_year", "citation_month", "chunk_text")
    block = F.concat_ws("\n", F.col("citation_title"), F.col("citation_url"), F.concat(F.col("citation_year").cast("string"), F.lit("-"), F.lpad(F.col("citation_month").cast("string"), 2, "0")), F.substring("chunk_text", 1, 100))
    return ck.select("chunk_id", F.md5(block).alias("digest"))


def str10_evidence_budget(spark, sf_dir):
    """Chunks of each context in order, as long as their texts together stay within 600 characters."""
    ck = live_chunks(spark, sf_dir, "chunk_text").select(F.col("chunk_id").alias("id"), F.length("chunk_text").alias("n"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return context_chunks(spark, sf_dir).join(ck, "id").withColumn("used", F.sum("n").over(w)).filter("used <= 600").select("qid", "id", "rank", "used")


def str07_split_references(spark, sf_dir):
    return entity_records(spark, sf_dir).filter("type = 'Work'").select(F.array_join(F.split("name", r"\s+(?:and|&)\s+"), "; ").alias("reference")).groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


def str13_without_thoughts(spark, sf_dir):
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "answer").distinct()
    return q.select("cache_key", F.length(T.without_thoughts(F.concat(F.lit("<think>a\nb</think> "), F.col("answer")))).alias("n"))


def jsn03_metadata_check(spark, sf_dir):
    """Documents whose metadata does not carry their year and month."""
    d = live_documents(spark, sf_dir, "metadata", "published_year", "published_month").withColumn("v", F.try_parse_json("metadata"))
    y, m = F.try_variant_get("v", "$.year", "string"), F.try_variant_get("v", "$.month", "string")
    same = y.eqNullSafe(F.col("published_year").cast("string")) & m.eqNullSafe(F.col("published_month").cast("string"))
    return d.filter(~same).select("doc_id", "published_year", "published_month")


def snk03_index_terms(spark, sf_dir):
    """Terms of the index with the number of chunks and occurrences."""
    return postings(live_chunks(spark, sf_dir, "chunk_text"), "chunk_id", "chunk_text").groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_uses"))


def src12_page(spark, sf_dir):
    """The third page of fifty chunks by key."""
    return live_chunks(spark, sf_dir).orderBy("chunk_id").offset(100).limit(50)


def src14_export(spark, sf_dir):
    """Entities with defaults in place of nulls."""
    e = entity_records(spark, sf_dir)
    return e.select("record_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence"), F.coalesce(F.size("aliases"), F.lit(0)).alias("n_aliases"))


def fil13_valid_pairs(spark, sf_dir):
    """Question and answer rows that ask, answer shortly, and share three words or more."""
    a = pick(table(spark, sf_dir, "agent_eval_example"), "id", "prompt", "reference").dropDuplicates(["id"])
    shared = F.size(F.array_intersect(terms("prompt"), terms("reference")))
    return a.filter(F.trim("prompt").endswith("?") & (F.length("reference") <= 200) & (shared >= 3)).select("id", shared.alias("n_shared"))


def vec02_dimensions(spark, sf_dir):
    """Chunks by the length of their vector (-1: no vector)."""
    ck = pick(table(spark, sf_dir, "kb_chunks"), "chunk_id", "embedding").dropDuplicates(["chunk_id"])
    return ck.groupBy(F.coalesce(F.size("embedding"), F.lit(-1)).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


def grf09_community_texts(spark, sf_dir):
    """Fallback summary of each community: its first five names, and how many more there are."""
    labels = label_communities(grf05_edges(spark, sf_dir))
    named = labels.join(entities(spark, sf_dir).select("entity_id", "name"), "entity_id")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("name", "entity_id"))).filter("r <= 5").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return first.join(size, "community").select("community", F.when(F.col("n") > 5, F.concat("names", F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise(F.col("names")).alias("summary"))


_CK = "ck as (select distinct on (chunk_id) * from kb_chunks where deleted_at is null)"
_T = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_R = "r as (select distinct on (record_id) * from extracted_entities)"
_ENT = _R + ", kb as (select distinct on (entity_id) entity_id, name, type from kb_entities), ent as (select * from kb union all select entity_id, m.name, m.type from (select entity_id, min({record_id: record_id, name: name, type: type}) m from r group by 1) where entity_id not in (select entity_id from kb))"
_MEN = f"""said as (select entity_id, name said, 0 alias from r union all select entity_id, unnest(aliases), 1 from r union all select entity_id, name, 0 from kb_entities union all select entity_id, unnest(aliases), 1 from kb_entities),
  kn as (select distinct entity_id, alias, array_to_string({_T.format('said')}, ' ') k from said), qs as (select qid, array_to_string({_T.format('query')}, ' ') w from q),
  men as (select qid, entity_id, min(case when w <> k and contains(' ' || w || ' ', ' ' || k || ' ') then 0.15::double when w <> k then 0.05::double when alias = 0 then 0.0::double else 0.02::double end) distance from qs, kn where length(k) >= 2 and length(w) >= 1 and (contains(' ' || w || ' ', ' ' || k || ' ') or alias = 0 and length(w) >= 2 and contains(' ' || k || ' ', ' ' || w || ' ')) group by 1, 2)"""
_ED = "rl as (select distinct on (record_id) * from extracted_relations), ed as (select distinct least(source_entity_id, target_entity_id) u, greatest(source_entity_id, target_entity_id) v from rl where source_entity_id <> target_entity_id and source_entity_id in (select entity_id from ent) and target_entity_id in (select entity_id from ent)), b as (select u, v from ed union all select v, u from ed)"
_CTX = "refs as (select qid, pos - 1 pos, lower(trim(ref)) ref from (select context_id qid, unnest(source_chunk_ids) ref, generate_subscripts(source_chunk_ids, 1) pos from (select distinct on (context_id) * from graph_contexts)) where trim(ref) <> ''), keys as (select chunk_id id, lower(chunk_id) ref from ck union all select chunk_id, lower(doc_id) || '_chunk_' || chunk_index from ck), cc as (select qid, id, row_number() over (partition by qid order by pos, id) rank from (select qid, id, min(pos) pos from refs join keys using (ref) group by 1, 2))"
SQL = {
    "jon05_text_mentions": f"with {_ENT}, q as (select distinct context_id qid, query from graph_contexts), {_MEN} select * from men",
    "top04_mention_order": f"with {_ENT}, q as (select distinct context_id qid, query from graph_contexts), {_MEN}, c as (select entity_id, coalesce(max(case when not isnan(confidence) and confidence between 0 and 1 then confidence end), 0) confidence from (select entity_id, confidence from r union all select entity_id, confidence from kb_entities) group by 1) select * from (select qid, entity_id, distance, confidence, row_number() over (partition by qid order by distance, confidence desc, entity_id) rank from men join c using (entity_id)) where rank <= 10",
    "grf01_local_context": f"with {_ENT}, q as (select distinct context_id qid, query from graph_contexts where context_id % 20 = 0), {_MEN}, {_ED} select qid, entity_id, min(d)::int distance from (select qid, entity_id, 0 d from men union all select qid, v, 1 from men join b on b.u = entity_id) group by 1, 2",
    "agg07_gleaned_only": f"with {_R} select distinct entity_id from r where extractor = 'gleaning' and entity_id not in (select entity_id from r where extractor <> 'gleaning')",
    "agg22_rule_scores": "with a as (select id, lower(coalesce(reference, '')) t, list_filter(list_concat(coalesce(metadata.work_search_eval.expected_title_contains, []), coalesce(metadata.work_search_eval.expected_writer_contains, [])), lambda x: x is not null) w from (select distinct on (id) * from agent_eval_example)), u as (select id, t, unnest(w) x from a) select id, count(*)::int n_checks, (count(*) filter (contains(t, lower(x))))::int n_passed, round(count(*) filter (contains(t, lower(x))) / count(*), 6) score from u group by 1",
    "top09_evidence_names": "with e as (select context_id, unnest(entities) e from (select distinct on (context_id) * from graph_contexts)), n as (select context_id, e.name nm, row_number() over (partition by context_id order by e.score desc, e.name) r from e where e.name is not null and e.score is not null) select * from (select context_id, string_agg(nm, '; ' order by r) names from n where r <= 10 group by 1) where names <> ''",
    "str09_evidence_blocks": f"with {_CK} select chunk_id, md5(concat_ws(chr(10), citation_title, citation_url, citation_year::varchar || '-' || lpad(citation_month::varchar, 2, '0'), substring(chunk_text, 1, 100))) digest from ck",
    "str10_evidence_budget": f"with {_CK}, {_CTX} select qid, id, rank, used from (select qid, id, rank, sum(length(chunk_text)) over (partition by qid order by rank)::bigint used from cc join ck on chunk_id = id where chunk_text is not null) where used <= 600",
    "str07_split_references": f"with {_R} select regexp_replace(name, '\\s+(?:and|&)\\s+', '; ', 'g') reference, count(*) n from r where type = 'Work' group by 1",
    "str13_without_thoughts": "select cache_key, length(regexp_replace(regexp_replace('<think>a' || chr(10) || 'b</think> ' || answer, '<think>.*?</think>', '', 'gs'), '^ +| +$', '', 'g'))::int n from (select distinct cache_key, answer from query_cache)",
    "jsn03_metadata_check": "with d as (select distinct on (doc_id) * from kb_documents where deleted_at is null) select doc_id, published_year, published_month from d where not (case when json_valid(metadata) then json_extract_string(metadata, '$.year') end is not distinct from published_year::varchar and case when json_valid(metadata) then json_extract_string(metadata, '$.month') end is not distinct from published_month::varchar)",
    "snk03_index_terms": f"with {_CK} select term, count(*) n_chunks, sum(tf)::bigint n_uses from (select chunk_id, term, count(*) tf from (select chunk_id, unnest({_T.format('chunk_text')}) term from ck) group by 1, 2) group by 1",
    "src12_page": f"with {_CK} select chunk_id from ck order by chunk_id limit 50 offset 100",
    "src14_export": f"with {_R} select record_id, coalesce(description, '') description, coalesce(case when isnan(confidence) then 0 else confidence end, 0) confidence, coalesce(len(aliases), 0)::int n_aliases from r",
    "fil13_valid_pairs": f"select id, n_shared from (select id, trim(prompt) p, reference, len(list_intersect(list_distinct({_T.format('prompt')}), list_distinct({_T.format('reference')})))::int n_shared from (select distinct on (id) * from agent_eval_example)) where p like '%?' and length(reference) <= 200 and n_shared >= 3",
    "vec02_dimensions": "select coalesce(len(embedding), -1)::int dimension, count(*) n from (select distinct on (chunk_id) * from kb_chunks) group by 1",
}
QUERIES = {n: globals()[n] for n in [*SQL, "grf09_community_texts"]}
