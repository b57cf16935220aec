"""Records of entities and relations merged into one: upserts by id, by name and type, by key over chunks; the merged
rows themselves, with their unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import entities, entity_records, jon04_relation_names, relation_records
from weftline.operators.skew import hub_join
from weftline.session import cut_table, pick, table

SEP = " | "


def sane(c: str = "confidence") -> Column:
    """A confidence between 0 and 1, else null."""
    return F.when(~F.isnan(c) & F.col(c).between(0, 1), F.col(c))


def union_of(rows: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    """keys, name: the different items of a group in order. Each is kept once on the map side already, so a group of
    any size sends no more than its different items."""
    each = rows.select(*keys, F.explode(items).alias("x")).filter("x is not null and trim(x) <> ''").distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias(name))


def first_seen(rows: DataFrame, keys: list[str], item: Column, order: str, name: str) -> DataFrame:
    """keys, name: the different items of a group in the order of their first occurrence."""
    each = rows.select(*keys, item.alias("x"), order).filter("x is not null and x <> ''").groupBy(*keys, "x").agg(F.min(order).alias("o"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias(name))


def merged_entities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, description (the longest, the first of equal ones), confidence (the best valid one), aliases and
    source_chunk_ids (unions in order), n_records. The first record gives the name."""
    longest = F.max(F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("record_id")).alias("o"), F.coalesce("description", F.lit("")).alias("d")))
    top = rows.groupBy(*keys).agg(longest.alias("l"), F.min(F.struct("record_id", "name")).alias("f"), F.max(sane()).alias("confidence"), F.count(F.lit(1)).alias("n_records"))
    out = top.select(*keys, F.col("f.name").alias("base"), F.col("l.d").alias("description"), "confidence", "n_records")
    none = F.array().cast("array<string>")
    for field in ("aliases", "source_chunk_ids"):
        out = out.join(union_of(rows, keys, F.col(field), field), keys, "left").withColumn(field, F.coalesce(field, none))
    return out


def snk04_entity_upsert(spark, sf_dir):
    """Records of an entity merged."""
    m = merged_entities(entity_records(spark, sf_dir), ["entity_id"])
    return m.select("entity_id", "description", "confidence", "n_records", F.array_join("aliases", SEP).alias("aliases"), F.array_join("source_chunk_ids", SEP).alias("source_chunk_ids"))


def snk06_merge_by_name(spark, sf_dir):
    """Records merged by name and type."""
    m = merged_entities(entity_records(spark, sf_dir).filter("name is not null and type is not null"), ["name", "type"])
    return m.select("name", "type", "description", "confidence", "n_records", F.array_join("aliases", SEP).alias("aliases"), F.size("source_chunk_ids").alias("n_chunks"))


def snk05_relation_upsert(spark, sf_dir):
    """Relations with one id merged: different evidences joined in their order, weights added, best confidence, chunk
    ids united."""
    r = relation_records(spark, sf_dir)
    top = r.groupBy("relation_id").agg(F.max("confidence").alias("confidence"), F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n_records"))
    ids, said = union_of(r, ["relation_id"], F.col("source_chunk_ids"), "ids"), first_seen(r, ["relation_id"], F.col("evidence"), "record_id", "said")
    j = top.join(said, "relation_id", "left").join(ids, "relation_id", "left")
    text = lambda c: F.coalesce(F.array_join(c, SEP), F.lit(""))
    return j.select("relation_id", "confidence", "weight", "n_records", text("said").alias("evidence"), text("ids").alias("source_chunk_ids"))


def snk07_relations_with_both_ends(spark, sf_dir):
    """Relations between known entities merged by the names of their ends and the type: every evidence appended in its
    order, also a repeated or empty one."""
    ids = entities(spark, sf_dir).select("entity_id", "name")
    a, b = ids.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("source_name")), ids.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("target_name"))
    r = relation_records(spark, sf_dir).select("record_id", "type", "source_entity_id", "target_entity_id", "evidence", "confidence")
    j = hub_join(r.join(a, "source_entity_id"), b, "target_entity_id")
    every = F.transform(F.array_sort(F.collect_list(F.struct("record_id", F.coalesce("evidence", F.lit("")).alias("e")))), lambda s: s["e"])
    return j.groupBy("source_name", "target_name", "type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.md5(F.array_join(every, SEP)).alias("evidence_digest"))


def agg05_merge_by_key(spark, sf_dir):
    """Records merged over chunks by canonical key or lower-case name; the first record gives the name, all other
    spellings are aliases; chunk ids in the order of their first record; the longest description."""
    key = F.coalesce(F.nullif(F.lower(F.trim("canonical_key")), F.lit("")), F.lower("name"))
    r = entity_records(spark, sf_dir).withColumn("key", key).filter("key is not null")
    m = merged_entities(r, ["key"]).drop("aliases", "source_chunk_ids")
    spelled = union_of(r, ["key"], F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), "spelled")
    places = r.select("key", "record_id", F.posexplode("source_chunk_ids").alias("pos", "x")).filter("trim(x) <> ''").groupBy("key", "x").agg(F.min(F.struct("record_id", "pos")).alias("o"))
    places = places.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("chunks"))
    j = m.join(spelled, "key", "left").join(places, "key", "left")
    others = F.filter(F.coalesce("spelled", F.array().cast("array<string>")), lambda x: ~x.eqNullSafe(F.col("base")))
    return j.select("key", F.col("base").alias("name"), "description", "confidence", "n_records", F.array_join(others, SEP).alias("aliases"), F.coalesce(F.array_join("chunks", SEP), F.lit("")).alias("source_chunk_ids"))


def agg06_merge_relations(spark, sf_dir):
    """Relations merged by their ends and type: the weight is the group's size, or its own if it is alone; different
    evidences joined in their order; chunk ids united."""
    keys = ["source_entity_id", "target_entity_id", "type"]
    r = relation_records(spark, sf_dir).filter(" and ".join(f"{k} is not null" for k in keys))
    top = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("own"), F.max("confidence").alias("confidence"))
    j = top.join(first_seen(r, keys, F.col("evidence"), "record_id", "said"), keys, "left").join(union_of(r, keys, F.col("source_chunk_ids"), "ids"), keys, "left")
    text = lambda c: F.coalesce(F.array_join(c, SEP), F.lit(""))
    return j.select(*keys, F.when(F.col("n") > 1, F.col("n").cast("double")).otherwise(F.col("own")).alias("weight"), "confidence", text("said").alias("evidence"), text("ids").alias("source_chunk_ids"))


def agg08_best_mention(spark, sf_dir):
    """Best score of each entity and of each relation over all graph contexts, with the first context that has it."""
    c = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "entities", "relations").dropDuplicates(["context_id"])
    best = F.min(F.struct((-F.col("score")).alias("s"), "context_id")).alias("b")
    e = c.select("context_id", F.inline("entities")).filter("entity_id is not null and score is not null")
    r = c.select("context_id", F.inline("relations")).filter("source_entity is not null and target_entity is not null and relation_type is not null and score is not null")
    by_entity = e.groupBy(F.lower(F.trim("entity_id")).alias("key")).agg(best).withColumn("kind", F.lit("entity"))
    by_relation = r.groupBy(F.concat_ws("|", "source_entity", "target_entity", "relation_type").alias("key")).agg(best).withColumn("kind", F.lit("relation"))
    return by_entity.unionByName(by_relation).select("kind", "key", (-F.col("b.s")).alias("score"), F.col("b.context_id").alias("context_id"))


def agg07_gleaned_merge(spark, sf_dir):
    """A second reading merged into the first: descriptions of both joined with a space, entities of rules added only
    where nothing else has them."""
    r = entity_records(spark, sf_dir).filter("entity_id is not null")
    part = lambda kind: F.min(F.when(F.col("extractor") == kind, F.struct("record_id", F.coalesce("description", F.lit("")).alias("d"))))
    g = r.groupBy("entity_id").agg(part("llm").alias("a"), part("gleaning").alias("b"), part("rule").alias("c"))
    both = F.trim(F.concat_ws(" ", F.nullif("a.d", F.lit("")), F.nullif("b.d", F.lit(""))))
    known = F.col("a").isNotNull() | F.col("b").isNotNull()
    return g.filter(known | F.col("c").isNotNull()).select("entity_id", F.when(known, both).otherwise(F.col("c.d")).alias("description"), F.when(known, "read").otherwise("rule").alias("origin"))


def jon08_deterministic_ids(spark, sf_dir):
    """Relations led to the smallest entity id with the name and type of each end; unmatched ends are skipped."""
    every = entity_records(spark, sf_dir).select("entity_id", "name", "type").unionByName(pick(table(spark, sf_dir, "kb_entities"), "entity_id", "name", "type"))
    ids = every.filter("name is not null").groupBy(F.concat_ws("|", F.lower("name"), "type").alias("k")).agg(F.min("entity_id").alias("id"))
    side = lambda end: ids.select(F.col("k").alias(f"k_{end}"), F.col("id").alias(f"{end}_id"))
    named = jon04_relation_names(spark, sf_dir)
    named = named.select("record_id", *[F.concat_ws("|", F.lower(f"{end}_name"), f"{end}_type").alias(f"k_{end}") for end in ("source", "target")])
    first = cut_table(hub_join(cut_table(named), side("source"), "k_source"))
    return hub_join(first, side("target"), "k_target").select("record_id", "source_id", "target_id")


def set05_other_aliases(spark, sf_dir):
    """Aliases of each record without its own name, repeats kept."""
    r = entity_records(spark, sf_dir).filter("aliases is not null")
    left = F.filter("aliases", lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("name")))
    return r.select("record_id", F.size(left).alias("n"), F.array_join(left, SEP).alias("aliases"))


_R = "r as (select distinct on (record_id) * from extracted_entities)"
_RL = "rl as (select distinct on (record_id) * from extracted_relations)"
_E = _R + ", kb as (select distinct on (entity_id) entity_id, name, type from kb_entities), ent as (select * from kb union all select entity_id, m.name, m.type from (select entity_id, min({record_id: record_id, name: name, type: type}) m from r group by 1) where entity_id not in (select entity_id from kb))"
_OK = "case when not isnan(confidence) and confidence between 0 and 1 then confidence end"
_LONG = "arg_max(coalesce(description, ''), (length(coalesce(description, '')), -record_id))"


def _union(keys: str, field: str, rel: str = "r", name: str = "x") -> str:
    return f"(select {keys}, string_agg(x, ' | ' order by x) {name} from (select distinct {keys}, x from (select {keys}, unnest({field}) x from {rel}) where trim(x) <> '') group by all)"


def _seen(keys: str, name: str = "s") -> str:
    return f"(select {keys}, string_agg(evidence, ' | ' order by o) {name} from (select {keys}, evidence, min(record_id) o from rl where evidence <> '' group by all) group by all)"


_KEYED = "k as (select *, coalesce(nullif(lower(trim(canonical_key)), ''), lower(name)) \"key\" from r where coalesce(nullif(lower(trim(canonical_key)), ''), lower(name)) is not null)"
SQL = {
    "snk04_entity_upsert": f"with {_R} select entity_id, description, confidence, n_records, coalesce(a, '') aliases, coalesce(c, '') source_chunk_ids from (select entity_id, {_LONG} description, max({_OK}) confidence, count(*) n_records from r group by 1) left join {_union('entity_id', 'aliases', 'r', 'a')} using (entity_id) left join {_union('entity_id', 'source_chunk_ids', 'r', 'c')} using (entity_id)",
    "snk06_merge_by_name": f"with {_R} select name, type, description, confidence, n_records, coalesce(a, '') aliases, coalesce(n, 0)::int n_chunks from (select name, type, {_LONG} description, max({_OK}) confidence, count(*) n_records from r where name is not null and type is not null group by 1, 2) left join {_union('name, type', 'aliases', 'r', 'a')} using (name, type) left join (select name, type, count(distinct x) n from (select name, type, unnest(source_chunk_ids) x from r) where trim(x) <> '' group by 1, 2) using (name, type)",
    "snk05_relation_upsert": f"with {_RL} select relation_id, confidence, weight, n_records, coalesce(s, '') evidence, coalesce(c, '') source_chunk_ids from (select relation_id, max(confidence) confidence, round(sum(weight), 6) weight, count(*) n_records from rl group by 1) left join {_seen('relation_id')} using (relation_id) left join {_union('relation_id', 'source_chunk_ids', 'rl', 'c')} using (relation_id)",
    "snk07_relations_with_both_ends": f"with {_E}, {_RL} select s.name source_name, t.name target_name, rl.type, count(*) n, max(confidence) confidence, md5(string_agg(coalesce(evidence, ''), ' | ' order by record_id)) evidence_digest from rl join ent s on s.entity_id = source_entity_id join ent t on t.entity_id = target_entity_id group by 1, 2, 3",
    "agg05_merge_by_key": f"with {_R}, {_KEYED}, m as (select \"key\", arg_min(name, record_id) name, {_LONG} description, max({_OK}) confidence, count(*) n_records from k group by 1), sp as (select distinct \"key\", x from (select \"key\", name x from k union all select \"key\", unnest(aliases) from k) where trim(x) <> ''), al as (select \"key\", string_agg(x, ' | ' order by x) a from sp join m using (\"key\") where x is distinct from name group by 1), pl as (select \"key\", x, min((record_id, pos)) o from (select \"key\", record_id, unnest(source_chunk_ids) x, generate_subscripts(source_chunk_ids, 1) pos from k) where trim(x) <> '' group by 1, 2), ch as (select \"key\", string_agg(x, ' | ' order by o) c from pl group by 1) select \"key\", name, description, confidence, n_records, coalesce(a, '') aliases, coalesce(c, '') source_chunk_ids from m left join al using (\"key\") left join ch using (\"key\")",
    "agg06_merge_relations": f"with {_RL} select source_entity_id, target_entity_id, type, weight, confidence, coalesce(s, '') evidence, coalesce(c, '') source_chunk_ids from (select source_entity_id, target_entity_id, type, case when count(*) > 1 then count(*)::double else max(weight) end weight, max(confidence) confidence from rl where source_entity_id is not null and target_entity_id is not null and type is not null group by 1, 2, 3) left join {_seen('source_entity_id, target_entity_id, type')} using (source_entity_id, target_entity_id, type) left join {_union('source_entity_id, target_entity_id, type', 'source_chunk_ids', 'rl', 'c')} using (source_entity_id, target_entity_id, type)",
    "agg08_best_mention": "with g as (select distinct on (context_id) * from graph_contexts), e as (select context_id, unnest(entities) e from g), r as (select context_id, unnest(relations) r from g), x as (select 'entity' kind, lower(trim(e.entity_id)) \"key\", e.score score, context_id from e where e.entity_id is not null union all select 'relation', r.source_entity || '|' || r.target_entity || '|' || r.relation_type, r.score, context_id from r where r.source_entity is not null and r.target_entity is not null and r.relation_type is not null) select kind, \"key\", score, context_id from (select *, row_number() over (partition by kind, \"key\" order by score desc, context_id) n from x where score is not null) where n = 1",
    "agg07_gleaned_merge": f"with {_R}, p as (select entity_id, extractor, arg_min(coalesce(description, ''), record_id) d from r where entity_id is not null group by 1, 2), g as (select entity_id, max(d) filter (extractor = 'llm') a, max(d) filter (extractor = 'gleaning') b, max(d) filter (extractor = 'rule') c from p group by 1) select entity_id, case when a is not null or b is not null then trim(concat_ws(' ', nullif(a, ''), nullif(b, ''))) else c end description, case when a is not null or b is not null then 'read' else 'rule' end origin from g where coalesce(a, b, c) is not null",
    "jon08_deterministic_ids": f"with {_E}, {_RL}, nm as (select record_id, lower(coalesce(s.name, source_entity_id)) sn, coalesce(s.type, '') st, lower(coalesce(t.name, target_entity_id)) tn, coalesce(t.type, '') tt from rl left join ent s on s.entity_id = source_entity_id left join ent t on t.entity_id = target_entity_id), ids as (select lower(name) n, type t, min(entity_id) id from (select entity_id, name, type from r union all select entity_id, name, type from kb_entities) where name is not null group by 1, 2) select record_id, a.id source_id, b.id target_id from nm join ids a on a.n = sn and a.t = st join ids b on b.n = tn and b.t = tt",
    "set05_other_aliases": f"with {_R}, l as (select record_id, list_filter(aliases, lambda x: x is not null and x is distinct from name) a from r where aliases is not null) select record_id, len(a)::int n, array_to_string(a, ' | ') aliases from l",
}
QUERIES = {n: globals()[n] for n in SQL}
