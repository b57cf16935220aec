"""References to records that do not exist, or that were deleted, or that came later than the reference.

Keys become integers within a key space: `doc_chunk_7` is 7 in the space of the document, a hexadecimal id is its
last ten digits in the space of the others, anything else is 0 in a space of its own. The sorted integers of the
parents are compressed into runs without gaps (at most RUN long), each with the state of its keys. A reference is
matched as-of to the run that starts last before it; beyond the end of that run there is no such parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.skew import heavy_split_join
from weftline.session import pick, strip, table

#: Longest run; also the width of the blocks in which references and runs meet, so that no window grows with a key space.
RUN = 1024
HEX_SPLIT = 10


def norm_key(c: Column | str) -> Column:
    """Without surrounding white space, in lower case; null if nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def key_space(key: Column) -> tuple[Column, Column]:
    """(space, integer) of a normal key. Only canonical digits are read as a number, so `_chunk_007` is not `_chunk_7`."""
    numbered = r"^(.*)_chunk_(0|[1-9][0-9]{0,17})$"
    hexa = r"^[0-9a-f]{11,16}$"
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    tail = lambda c: F.conv(F.right(c, F.lit(HEX_SPLIT)), 16, 10).cast("bigint")
    cut = F.length(key) - HEX_SPLIT
    space = (
        F.when(key.rlike(numbered), F.concat(F.lit("c:"), F.regexp_extract(key, numbered, 1)))
        .when(key.rlike(hexa), F.concat(F.lit("h"), cut.cast("string"), F.lit(":"), F.left(key, cut)))
        .when(key.rlike(uuid), F.concat(F.lit("u:"), F.left(key, cut)))
        .otherwise(F.concat(F.lit("s:"), key))
    )
    n = F.when(key.rlike(numbered), F.regexp_extract(key, numbered, 2).cast("bigint")).when(key.rlike(hexa) | key.rlike(uuid), tail(key)).otherwise(F.lit(0).cast("bigint"))
    return space, n


def with_key_space(df: DataFrame, key: str = "key") -> DataFrame:
    space, n = key_space(F.col(key))
    return df.withColumn("space", space).withColumn("n", n).withColumn("block", F.floor(F.col("n") / F.lit(RUN)))


def parent_runs(parents: DataFrame) -> DataFrame:
    """parents: family, key, created_at, deleted_at, many rows a key. One row a run: family, space, block,
    run_start, run_end, states (array by position: earliest created_at, whether all records are deleted).

    Null keys are no parents. A repeated record changes nothing. An empty table has no runs."""
    keys = with_key_space(
        parents.filter(F.col("key").isNotNull())
        .groupBy("family", "key")
        .agg(F.min("created_at").alias("earliest"), F.min(F.col("deleted_at").isNotNull()).alias("all_deleted"))
    )
    w = Window.partitionBy("family", "space", "block").orderBy("n")
    return (
        keys.withColumn("island", F.col("n") - F.row_number().over(w))
        .groupBy("family", "space", "block", "island")
        .agg(
            F.min("n").alias("run_start"),
            F.max("n").alias("run_end"),
            F.transform(F.sort_array(F.collect_list(F.struct("n", "earliest", "all_deleted"))), lambda x: F.struct(x["earliest"].alias("earliest"), x["all_deleted"].alias("all_deleted"))).alias("states"),
        )
        .drop("island")
    )


def match_as_of(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """keys: family, key (distinct), with any further columns. Adds `state`: null if no parent has the key."""
    rest = [c for c in keys.columns if c not in ("family", "key")]
    left = with_key_space(keys).select("family", "space", "block", "n", F.lit(1).alias("side"), F.struct("key", *rest).alias("ref"), F.lit(None).cast(runs.select(F.struct("run_start", "run_end", "states")).schema[0].dataType).alias("run"))
    right = runs.select("family", "space", "block", F.col("run_start").alias("n"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["ref"].dataType).alias("ref"), F.struct("run_start", "run_end", "states").alias("run"))
    w = Window.partitionBy("family", "space", "block").orderBy("n", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("before", F.last("run", ignorenulls=True).over(w)).filter("side = 1")
    within = F.col("before").isNotNull() & (F.col("n") <= F.col("before.run_end"))
    state = F.when(within, F.get(F.col("before.states"), (F.col("n") - F.col("before.run_start")).cast("int")))
    return both.select("family", "ref.*", state.alias("state"))


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan references with their kind and month.

    refs: table_name, field_name, record_key, ref (as written), families (array of parent families in order of
    precedence: the first family that has the key decides), created_at. parents: family, key (normal), created_at,
    deleted_at. Result: table_name, field_name, record_key, ref_key, orphan_kind, period; distinct rows.

    Null and blank references do not count; a null created_at of the reference is never late and has a null
    period; a parent without created_at never makes a reference late. Repeated rows and ties give one row."""
    refs = refs.withColumn("key", norm_key("ref")).filter(F.col("key").isNotNull())
    # one row a key: a hot key is gathered on the map side before any shuffle
    counts = refs.groupBy("families", "key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("created_at").alias("first_ref"))
    asked = counts.select("key", "families", "n_rows", "first_ref", F.posexplode("families").alias("order", "family"))
    wanted = asked.select("family", "key").distinct()
    states = match_as_of(wanted, parent_runs(parents)).filter(F.col("state").isNotNull())
    best = (
        asked.join(states, ["family", "key"], "left")
        .groupBy("families", "key")
        .agg(F.max("first_ref").alias("first_ref"), F.min(F.when(F.col("state").isNotNull(), F.struct("order", "state"))).alias("best"))
        .select("families", "key", "first_ref", F.col("best.state.earliest").alias("earliest"), F.col("best.state.all_deleted").alias("all_deleted"), F.col("best").isNull().alias("missing"))
    )
    suspect = best.filter(F.col("missing") | F.col("all_deleted") | (F.col("earliest") > F.col("first_ref"))).drop("first_ref")
    joined = heavy_split_join(refs, suspect, ["families", "key"], counts.select("families", "key", "n_rows"))
    kind = F.when(F.col("missing"), "missing").when(F.col("all_deleted"), "deleted").when(F.col("earliest") > F.col("created_at"), "late")
    return (
        joined.withColumn("orphan_kind", kind)
        .filter(F.col("orphan_kind").isNotNull())
        .select("table_name", "field_name", "record_key", strip("ref").alias("ref_key"), "orphan_kind", F.date_format("created_at", "yyyy-MM").alias("period"))
        .distinct()
    )


def kb_references(relations: DataFrame, contexts: DataFrame) -> DataFrame:
    """The references of extracted_relations and graph_contexts in the form that find_orphans takes."""
    rel = pick(relations, "record_id", "source_entity_id", "target_entity_id", "created_at")
    ends = rel.select(
        F.lit("extracted_relations").alias("table_name"),
        F.col("record_id").cast("string").alias("record_key"),
        "created_at",
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("ref")) for c in ("source_entity_id", "target_entity_id")])),
    )
    ctx = pick(contexts, "context_id", "source_chunk_ids", "created_at")
    chunks = ctx.select(F.lit("graph_contexts").alias("table_name"), F.col("context_id").cast("string").alias("record_key"), "created_at", F.lit("source_chunk_ids").alias("field_name"), F.explode("source_chunk_ids").alias("ref"))
    order = ["table_name", "field_name", "record_key", "ref", "families", "created_at"]
    return (
        ends.withColumn("families", F.array(F.lit("entity_id"), F.lit("entity_name"))).select(order)
        .unionByName(chunks.withColumn("families", F.array(F.lit("chunk"))).select(order))
    )


def kb_parents(extracted: DataFrame, shared: DataFrame, chunks: DataFrame) -> DataFrame:
    """Keys of entities (by id and by name, of both entity tables) and of chunks (by either key)."""
    ent = pick(extracted, "entity_id", "name", "created_at", "deleted_at").unionByName(pick(shared, "entity_id", "name", "created_at").withColumn("deleted_at", F.lit(None).cast("timestamp")))
    ck = pick(chunks, "chunk_id", "doc_id", "chunk_index", "created_at", "deleted_at")
    as_rows = lambda df, pairs: df.select("created_at", "deleted_at", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), norm_key(c).alias("key")) for f, c in pairs])))
    by_place = F.concat(F.col("doc_id"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return as_rows(ent, [("entity_id", F.col("entity_id")), ("entity_name", F.col("name"))]).unionByName(as_rows(ck, [("chunk", F.col("chunk_id")), ("chunk", by_place)]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return find_orphans(kb_references(t("extracted_relations"), t("graph_contexts")), kb_parents(t("extracted_entities"), t("kb_entities"), t("kb_chunks")))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, month and kind."""
    return p3_found(spark, sf_dir).groupBy("table_name", "field_name", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_key").alias("n_keys"))


_NORM = r"lower(regexp_replace({0}, '^[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]+|[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]+$', '', 'g'))"
_TRIM = _NORM[6:-1]
_FOUND_SQL = f"""
with ent as (select entity_id, name, created_at, deleted_at from extracted_entities union all select entity_id, name, created_at, null from kb_entities),
ids as (select {_NORM.format('entity_id')} k, min(created_at) earliest, bool_and(deleted_at is not null) gone from ent group by 1),
names as (select {_NORM.format('name')} k, min(created_at) earliest, bool_and(deleted_at is not null) gone from ent group by 1),
ck as (select {_NORM.format('chunk_id')} k, created_at, deleted_at from kb_chunks union all select {_NORM.format("doc_id || '_chunk_' || chunk_index")}, created_at, deleted_at from kb_chunks),
chunk as (select k, min(created_at) earliest, bool_and(deleted_at is not null) gone from ck group by 1),
ends as (select 'extracted_relations' table_name, 'source_entity_id' field_name, record_id::varchar record_key, source_entity_id ref, created_at from extracted_relations
  union select 'extracted_relations', 'target_entity_id', record_id::varchar, target_entity_id, created_at from extracted_relations),
ctx as (select distinct 'graph_contexts' table_name, 'source_chunk_ids' field_name, context_id::varchar record_key, unnest(source_chunk_ids) ref, created_at from graph_contexts),
found as (
  select e.*, coalesce(i.earliest, n.earliest) earliest, case when i.k is not null then i.gone else n.gone end gone, i.k is null and n.k is null missing
  from ends e left join ids i on i.k = {_NORM.format('e.ref')} left join names n on n.k = {_NORM.format('e.ref')}
  union all
  select c.*, k.earliest, k.gone, k.k is null from ctx c left join chunk k on k.k = {_NORM.format('c.ref')}),
kinds as (select table_name, field_name, record_key, {_TRIM.format('ref')} ref_key, case when missing then 'missing' when gone then 'deleted' when earliest > created_at then 'late' end orphan_kind, strftime(created_at, '%Y-%m') period
  from found where ref is not null and {_NORM.format('ref')} <> '')
"""

SQL = {
    "p3_found": _FOUND_SQL + "select distinct table_name, field_name, record_key, ref_key, orphan_kind, period from kinds where orphan_kind is not null",
    "p3_report": _FOUND_SQL + ", o as (select distinct * from kinds where orphan_kind is not null) select table_name, field_name, period, orphan_kind, count(*) n_references, count(distinct ref_key) n_keys from o group by all",
}
QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
