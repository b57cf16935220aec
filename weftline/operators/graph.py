"""The knowledge graph held in plain tables: merging, endpoints, neighbours, audits, communities, deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import noise_class
from weftline.operators.text_queries import NOISE_SQL
from weftline.operators.components import connected_components
from weftline.operators.skew import HEAVY_PART, heavy_split_join, hub_join
from weftline.session import cut, cut_table, pick, plain_plans, table


def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["record_id", "chunk_id", "entity_id", "type", "name", "canonical_key", "description", "aliases", "confidence", "source_chunk_ids", "extractor", "created_at", "updated_at", "deleted_at"]
    return pick(table(spark, sf_dir, "extracted_entities"), *cols).dropDuplicates(["record_id"])


def relation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["record_id", "relation_id", "type", "source_entity_id", "target_entity_id", "evidence", "confidence", "weight", "source_chunk_ids", "created_at"]
    return pick(table(spark, sf_dir, "extracted_relations"), *cols).dropDuplicates(["record_id"])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entity id of either table: its name and type from the smallest record."""
    ex = entity_records(spark, sf_dir).groupBy("entity_id").agg(F.min(F.struct("record_id", "name", "type")).alias("m")).select("entity_id", "m.name", "m.type")
    kb = pick(table(spark, sf_dir, "kb_entities"), "entity_id", "name", "type").dropDuplicates(["entity_id"])
    return kb.unionByName(ex.join(kb, "entity_id", "left_anti"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted edges (u < v): dangling ends and loops dropped, null weights 1, parallel ones summed."""
    rel = relation_records(spark, sf_dir).select("source_entity_id", "target_entity_id", F.coalesce("weight", F.lit(1.0)).alias("weight")).filter("source_entity_id <> target_entity_id")
    ids = entities(spark, sf_dir).select("entity_id")
    rel = hub_join(rel.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi"), ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id")
    return rel.groupBy(F.least("source_entity_id", "target_entity_id").alias("u"), F.greatest("source_entity_id", "target_entity_id").alias("v")).agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("u", "v")).alias("entity_id"))
    return entities(spark, sf_dir).join(ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def jon04_relation_names(spark, sf_dir):
    """Relations with the names of their ends; an unknown end keeps its id as its name."""
    ids = entities(spark, sf_dir)
    side = lambda p: ids.select(F.col("entity_id").alias(f"{p}_entity_id"), F.col("name").alias(f"{p}_n"), F.col("type").alias(f"{p}_t"))
    ends = relation_records(spark, sf_dir).select("record_id", "source_entity_id", "target_entity_id")
    j = hub_join(ends.join(side("source"), "source_entity_id", "left"), side("target"), "target_entity_id", "left")
    return j.select("record_id", F.coalesce("source_n", "source_entity_id").alias("source_name"), F.coalesce("source_t", F.lit("")).alias("source_type"), F.coalesce("target_n", "target_entity_id").alias("target_name"), F.coalesce("target_t", F.lit("")).alias("target_type"))


def jon06_relations_among_names(spark, sf_dir):
    """Relations both ends of which are mentioned by name in some graph context."""
    names = pick(table(spark, sf_dir, "graph_contexts"), "context_id", "entities").select(F.inline("entities")).select("name").filter("name is not null").distinct()
    r = jon04_relation_names(spark, sf_dir)
    return r.join(names.withColumnRenamed("name", "source_name"), "source_name", "left_semi").join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select("record_id", "source_name", "target_name")


def jon07_resolved_ends(spark, sf_dir):
    """Both ends of relations resolved by id, else by name, else by alias; the smallest id of equal names."""
    r = relation_records(spark, sf_dir)
    ends = r.select("record_id", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.lower(F.trim(f"{side}_entity_id")).alias("ref")) for side in ("source", "target")]))).filter("ref <> ''")
    e = entity_records(spark, sf_dir)
    by_id = e.select(F.lower("entity_id").alias("ref"), F.lit(0).alias("o"), "entity_id")
    by_name = e.select(F.lower(F.trim("name")).alias("ref"), F.lit(1).alias("o"), "entity_id")
    by_alias = e.select(F.explode("aliases").alias("ref"), F.lit(2).alias("o"), "entity_id").withColumn("ref", F.lower(F.trim("ref")))
    keys = by_id.unionByName(by_name).unionByName(by_alias).filter("ref <> ''").groupBy("ref").agg(F.min(F.struct("o", "entity_id")).alias("m"))
    return hub_join(ends, keys, "ref").select("record_id", "side", F.col("m.entity_id").alias("entity_id"), F.element_at(F.array(F.lit("id"), F.lit("name"), F.lit("alias")), F.col("m.o") + 1).alias("by"))


def jon09_documents_without_entities(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "kb_documents"), "doc_id").distinct()
    done = entity_records(spark, sf_dir).select(F.regexp_replace("chunk_id", "_chunk_[0-9]+$", "").alias("doc_id")).distinct()
    return docs.join(done, "doc_id", "left_anti")


def jon10_orphan_entities(spark, sf_dir):
    return degrees(spark, sf_dir).filter("degree = 0").select("entity_id", "name", "type")


def jon11_overlap(spark, sf_dir):
    """Entities with a record from a chunk that a graph context names."""
    named = pick(table(spark, sf_dir, "graph_contexts"), "source_chunk_ids").select(F.explode("source_chunk_ids").alias("c")).filter("c is not null").distinct()
    return entity_records(spark, sf_dir).select("entity_id", F.explode("source_chunk_ids").alias("c")).join(named, "c", "left_semi").select("entity_id").distinct()


def jon12_containment(spark, sf_dir):
    """Cached answers by document that they cite and that was deleted."""
    gone = pick(table(spark, sf_dir, "kb_documents"), "doc_id", "deleted_at").filter("deleted_at is not null").select("doc_id").distinct()
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "source_doc_ids").dropDuplicates(["cache_key"]).select("cache_key", F.explode("source_doc_ids").alias("doc_id")).distinct()
    return q.join(gone, "doc_id")


def jon15_neighbours(spark, sf_dir, depth: int = 2):
    """Entities within two steps of the entities of type LicenseTerm, with their distance; the seeds are left out."""
    e = edges(spark, sf_dir)
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = entities(spark, sf_dir).filter("type = 'LicenseTerm'").select("entity_id", F.lit(0).alias("distance"))
    front = seen
    for step in range(1, depth + 1):
        new = front.select(F.col("entity_id").alias("u")).join(both, "u").select(F.col("v").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti").withColumn("distance", F.lit(step))
        front = cut(new)
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def agg09_counts(spark, sf_dir):
    r = entity_records(spark, sf_dir)
    key = F.nullif(F.trim("canonical_key"), F.lit(""))
    return r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"), F.countDistinct("name", "type").alias("n_name_types"), F.countDistinct(key).alias("n_keys"), F.countDistinct(F.split_part("chunk_id", F.lit("_chunk_"), F.lit(1))).alias("n_docs"))


def agg10_type_shares(spark, sf_dir):
    c = entity_records(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


def agg11_degree_stats(spark, sf_dir):
    d = degrees(spark, sf_dir)
    return d.agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.avg("degree"), 6).alias("mean"), F.round(F.percentile("degree", 0.5), 6).alias("p50"), F.round(F.percentile("degree", 0.9), 6).alias("p90"), F.round(F.percentile("degree", 0.99), 6).alias("p99"), F.round(F.stddev_samp("degree"), 6).alias("sd"))


def agg12_orphan_rate(spark, sf_dir):
    return degrees(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("degree") == 0).alias("n_orphans")).withColumn("rate", F.round(F.col("n_orphans") / F.col("n"), 6))


def agg13_name_lengths(spark, sf_dir):
    """Lengths of names in six buckets, orphans beside connected entities, with their mean, least, greatest and middle
    length (the upper one of two middles)."""
    n = F.length("name")
    bucket = F.when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 30, "21-30").when(n <= 50, "31-50").otherwise("51+")
    counted = degrees(spark, sf_dir).groupBy(bucket.alias("bucket"), n.alias("n")).agg(F.count_if(F.col("degree") == 0).alias("o"), F.count_if(F.col("degree") > 0).alias("c"))  # lengths are few
    below = Window.partitionBy("bucket").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    every = F.col("o") + F.col("c")
    lengths = counted.filter("n is not null").withColumn("upto", F.sum(every).over(below)).withColumn("all", F.sum(every).over(Window.partitionBy("bucket")))
    middle = lengths.groupBy("bucket").agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"))
    g = counted.groupBy("bucket").agg(F.sum("o").alias("n_orphans"), F.sum("c").alias("n_connected"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum(F.col("n") * every) / F.sum(F.when(F.col("n").isNotNull(), every)), 6).alias("mean"))
    return g.join(middle, "bucket", "left")


def agg14_common_names(spark, sf_dir):
    return entity_records(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)


def agg24_cross_referenced(spark, sf_dir):
    """Entities from several chunks, without any description, and with a best confidence below a half."""
    r = entity_records(spark, sf_dir)
    ids = r.select("entity_id", F.explode("source_chunk_ids").alias("c")).filter("trim(c) <> ''").groupBy("entity_id").agg(F.countDistinct("c").alias("n"))
    valid = F.when(~F.isnan("confidence") & F.col("confidence").between(0, 1), F.col("confidence"))
    own = r.groupBy("entity_id").agg(F.max(F.coalesce(F.length(F.trim("description")), F.lit(0))).alias("d"), F.max(valid).alias("conf"))
    return own.join(ids, "entity_id", "left").agg(F.count_if(F.col("n") > 1).alias("n_cross_referenced"), F.count_if(F.col("d") == 0).alias("n_undescribed"), F.count_if(F.coalesce("conf", F.lit(0.0)) < 0.5).alias("n_doubtful"), F.count(F.lit(1)).alias("n_entities"))


def top07_hubs(spark, sf_dir):
    return degrees(spark, sf_dir).orderBy(F.desc("degree"), "entity_id").limit(25).select("entity_id", "name", "degree")


def grf05_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def _named_chunks(spark, sf_dir) -> DataFrame:
    """Composite ids of the chunks of deleted documents."""
    gone = pick(table(spark, sf_dir, "kb_documents"), "doc_id", "deleted_at").filter("deleted_at is not null").select("doc_id").distinct()
    ck = pick(table(spark, sf_dir, "kb_chunks"), "doc_id", "chunk_index").distinct()
    return ck.join(gone, "doc_id", "left_semi").select(F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("c"))


def grf10_prune(spark, sf_dir):
    """What deleting the chunks of deleted documents does to each record that names one: pruned, or deleted if no
    other chunk is left. A record without chunk ids is deleted too, as a condition on all of none holds."""
    r = entity_records(spark, sf_dir).select("record_id", F.explode_outer("source_chunk_ids").alias("c"))
    marked = r.join(_named_chunks(spark, sf_dir).withColumn("hit", F.lit(1)), "c", "left")
    g = marked.groupBy("record_id").agg(F.count("c").alias("n"), F.count("hit").alias("n_hit"))
    return g.select("record_id", F.when(F.col("n") == F.col("n_hit"), "delete").when(F.col("n_hit") > 0, "prune").alias("action"), (F.col("n") - F.col("n_hit")).alias("n_left")).filter("action is not null")


def grf11_orphan_relations(spark, sf_dir):
    """Relations to delete: an end is missing, or they name no chunk."""
    ids = entities(spark, sf_dir).select("entity_id")
    r = relation_records(spark, sf_dir)
    a = r.select("record_id", "source_entity_id", "target_entity_id", F.size("source_chunk_ids").alias("n_chunks")).join(ids.withColumnRenamed("entity_id", "source_entity_id").withColumn("s", F.lit(1)), "source_entity_id", "left")
    a = hub_join(a, ids.withColumnRenamed("entity_id", "target_entity_id").withColumn("t", F.lit(1)), "target_entity_id", "left")
    return a.filter(F.col("s").isNull() | F.col("t").isNull() | (F.coalesce("n_chunks", F.lit(0)) <= 0)).select("record_id")


def grf12_noise_orphans(spark, sf_dir):
    return degrees(spark, sf_dir).filter("degree = 0").withColumn("noise", noise_class(F.col("name"))).groupBy("type").agg(F.count("noise").alias("n_noise"), F.count(F.lit(1)).alias("n_orphans"))


def grf13_scorecard(spark, sf_dir):
    d = degrees(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("degree") == 0).alias("n_orphans"))
    e = edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_edges"))
    return d.crossJoin(e).select("n_entities", "n_edges", F.round(F.col("n_edges") / F.col("n_entities"), 6).alias("ratio"), F.round(F.col("n_orphans") / F.col("n_entities") * 100, 6).alias("orphan_rate"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v", "weight").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


#: A vertex with more neighbours than this, and more than a thousandth of all edges, hears by broadcast.
HUB_ROWS = 100_000


def numbered(e: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The vertices (id, entity_id, turns) and the edges both ways between their ids. Ids are in the order of the names.
    Bit i of turns is the half of the vertices in which this one is in rounds 2 i and 2 i + 1."""
    if max_rounds > 126:
        raise ValueError("turns has 63 bits")
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = e.select(F.explode(F.array("u", "v")).alias("entity_id")).filter("entity_id is not null").distinct()
    bits = reduce(lambda a, i: a.bitwiseOR(F.shiftleft(F.pmod(F.xxhash64("entity_id", F.lit(i)), F.lit(2)), i)), range((max_rounds + 1) // 2), F.lit(0).cast("long"))
    ids = cut_table(names.repartitionByRange(parts, "entity_id").sortWithinPartitions("entity_id").select(F.monotonically_increasing_id().alias("id"), "entity_id", bits.alias("turns")))
    side = lambda end: ids.select(F.col("entity_id").alias(end), F.col("id").alias("i" + end))
    ends = hub_join(cut_table(hub_join(e.select("u", "v", "weight"), side("u"), "u")), side("v"), "v")
    return ids, cut_table(ends.select(F.col("iu").alias("u"), F.col("iv").alias("v"), "weight"))


def named(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Names in place of the ids in entity_id and community."""
    labels = hub_join(labels, ids.select(F.col("id").alias("community"), F.col("entity_id").alias("label")), "community")
    return labels.drop("community").withColumnRenamed("entity_id", "id").join(ids.select("id", "entity_id"), "id").drop("id").withColumnRenamed("label", "community")


class Neighbours:
    """The edges of a numbered graph both ways, laid out once by the vertex that speaks, so that a round of labels joins
    them where they lie. Edges of hubs stay spread, the labels of hubs (fewer than HEAVY_PART) are broadcast."""

    def __init__(self, e: DataFrame) -> None:
        both = both_ways(e)
        sizes = both.groupBy("v").agg(F.count(F.lit(1)).alias("n_rows"))
        hubs = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n_rows").alias("total")))).filter((F.col("n_rows") > HUB_ROWS) & (F.col("n_rows") * HEAVY_PART > F.col("total"))).select("v")
        self.hubs = cut(hubs)
        self.hot = None if self.hubs.isEmpty() else cut_table(both.join(F.broadcast(self.hubs), "v", "left_semi"))
        rest = both if self.hot is None else both.join(F.broadcast(self.hubs), "v", "left_anti")
        self.parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.edges = cut(rest.repartition(self.parts, "v").sortWithinPartitions("v"))
        self.vertices = both.select("v").distinct().repartition(self.parts, "v")

    def hear(self, labels: DataFrame) -> DataFrame:
        """u, community, weight: what each vertex hears from its neighbours. labels: v, community."""
        heard = self.edges.join(labels.hint("merge"), "v").select("u", "community", "weight")
        if self.hot is None:
            return heard
        own = labels.join(F.broadcast(self.hubs), "v", "left_semi")
        return heard.unionByName(self.hot.join(F.broadcast(own), "v").select("u", "community", "weight"))


def propagate(near: Neighbours, ids: DataFrame, max_rounds: int) -> DataFrame:
    """v, community: labels of the vertices of `near` when no vertex wants to move any more (label_communities)."""
    labels = cut(near.vertices.join(ids.select(F.col("id").alias("v"), "turns").hint("merge"), "v").select("v", F.col("v").alias("community"), "turns"))
    for r in range(max_rounds):
        heard = near.hear(labels.select("v", "community")).select("u", "community", "weight", F.lit(0).alias("own"), F.lit(0).cast("long").alias("turns"))
        every = heard.unionByName(labels.select(F.col("v").alias("u"), "community", F.lit(None).cast("double").alias("weight"), F.lit(1).alias("own"), "turns"))
        sums = every.groupBy("u", "community").agg(F.round(F.sum("weight"), 6).alias("w"), F.max("own").alias("own"), F.max("turns").alias("turns"))
        best = sums.groupBy("u").agg(F.min(F.when(F.col("w").isNotNull(), F.struct((-F.col("w")).alias("w"), "community"))).alias("b"), F.max(F.when(F.col("own") == 1, F.col("community"))).alias("own"), F.coalesce(F.max(F.when(F.col("own") == 1, F.col("w"))), F.lit(0.0)).alias("stay"), F.max("turns").alias("turns"))
        wants = (-F.col("b.w")) > F.col("stay")
        turn = F.shiftright("turns", r // 2).bitwiseAND(F.lit(1)) == r % 2
        moved = cut(best.select(F.col("u").alias("v"), F.when(wants & turn, F.col("b.community")).otherwise(F.col("own")).alias("community"), "turns", wants.alias("wants")))
        labels = moved.drop("wants")
        if moved.filter("wants").isEmpty():
            return labels.drop("turns")
    raise RuntimeError(f"communities did not settle in {max_rounds} rounds")


def label_communities(e: DataFrame, max_rounds: int = 100) -> DataFrame:
    """entity_id, community: weighted label propagation until no vertex wants to move. A vertex wants the label of
    greatest weight among its neighbours (the smallest of equal ones) if it outweighs its present one's; in each round
    the half of the vertices moves whose hash agrees with the round, so that neighbours do not swap for ever.
    Sums by label are gathered on the map side, so a hub costs no more than its different labels. A round is one plan
    of numbers with two exchanges, and is not planned again while it runs: the driver keeps little of each."""
    ids, e = numbered(e, max_rounds)
    with plain_plans(e.sparkSession):
        labels = propagate(Neighbours(e), ids, max_rounds)
    return cut_table(named(labels.withColumnRenamed("v", "entity_id"), ids))


def community_levels(e: DataFrame, levels: int = 3, max_rounds: int = 100) -> DataFrame:
    """level, entity_id, community: the communities of the graph, then those of the graph between them, and so on. A
    community is named by its level and its label; one without an edge to another stays as it is."""
    ids, e = numbered(e, max_rounds)
    out = members = None
    with plain_plans(e.sparkSession):
        for level in range(levels):
            near = Neighbours(e)
            step = propagate(near, ids, max_rounds)
            if members is None:
                members = step.withColumnRenamed("v", "entity_id")
            else:
                above = step.select(F.col("v").alias("community"), F.col("community").alias("next"))
                members = cut_table(heavy_split_join(members, above, ["community"], members.groupBy("community").agg(F.count(F.lit(1)).alias("n_rows")), how="left").select("entity_id", F.coalesce("next", "community").alias("community")))
            rows = members.select(F.lit(level).alias("level"), "entity_id", "community")
            out = rows if out is None else out.unionByName(rows)
            if level + 1 < levels:
                heard = near.hear(step).groupBy("u", F.col("community").alias("cv")).agg(F.sum("weight").alias("weight"))
                ends = heard.join(step.select(F.col("v").alias("u"), F.col("community").alias("cu")).hint("merge"), "u").filter("cu < cv")
                e = cut_table(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.round(F.sum("weight"), 6).alias("weight")))
    out = named(cut_table(out), ids)
    return cut_table(out.select("level", "entity_id", F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("_"), "community").alias("community")))


def community_table(levels: DataFrame, e: DataFrame, least: int = 3) -> DataFrame:
    """level, community, parent, n_members, inner_weight of communities of `least` members or more. The parent is the
    next level's community of the smallest member; the last level has none."""
    first = levels.groupBy("level", "community").agg(F.count(F.lit(1)).alias("n_members"), F.min("entity_id").alias("entity_id")).filter(F.col("n_members") >= least)
    above = levels.select((F.col("level") - 1).alias("level"), "entity_id", F.col("community").alias("parent"))
    own = first.join(above, ["level", "entity_id"], "left")
    per_level = levels.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("level", "community"))).alias("cs"))  # as many as there are levels
    side = lambda end: per_level.select(F.col("entity_id").alias(end), F.col("cs").alias("c" + end))
    ends = hub_join(cut_table(hub_join(e, side("u"), "u")), side("v"), "v")
    shared = ends.select("weight", F.explode(F.array_intersect("cu", "cv")).alias("c")).groupBy(F.col("c.level").alias("level"), F.col("c.community").alias("community")).agg(F.round(F.sum("weight"), 4).alias("inner_weight"))
    return own.join(shared, ["level", "community"], "left").select("level", "community", "parent", "n_members", F.coalesce("inner_weight", F.lit(0.0)).alias("inner_weight"))


def graph_levels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = cut_table(edges(spark, sf_dir))
    return community_levels(e), e


def grf06_communities(spark, sf_dir):
    """Communities of three members or more on three levels, with their parent, size and inner weight."""
    return community_table(*graph_levels(spark, sf_dir))


def grf07_parents(spark, sf_dir):
    """How many communities of each level have a parent, and how many parents they have between them."""
    return grf06_communities(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n_communities"), F.count("parent").alias("n_with_parent"), F.countDistinct("parent").alias("n_parents"))


def grf08_inner_relations(spark, sf_dir):
    """Relations with both ends in one community of the first level, their evidence on one line and cut at 120
    characters, as it is shown in a description."""
    levels, _ = graph_levels(spark, sf_dir)
    own = levels.filter("level = 0")
    side = lambda end: own.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("community").alias(end))
    rel = relation_records(spark, sf_dir).select("record_id", "type", "source_entity_id", "target_entity_id", F.left(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s*\n\s*", " "), F.lit(120)).alias("evidence"))
    inside = hub_join(cut_table(hub_join(rel, side("source"), "source_entity_id")), side("target"), "target_entity_id").filter("source = target")
    return inside.select(F.col("source").alias("community"), "record_id", "type", "evidence")


def snk08_membership(spark, sf_dir):
    """The links between entities and their communities that are stored: those of communities of three members or more."""
    levels, e = graph_levels(spark, sf_dir)
    return levels.join(community_table(levels, e).select("level", "community"), ["level", "community"], "left_semi").select("entity_id", "level", "community")


def top06_communities(spark, sf_dir):
    """The five communities of greatest inner weight."""
    return grf06_communities(spark, sf_dir).orderBy(F.desc("inner_weight"), "level", "community").limit(5)


def grf05_components(spark, sf_dir):
    """Sizes of the connected components of the graph."""
    c = connected_components(edges(spark, sf_dir).select("u", "v"))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))


def hsh01_relation_ids(spark, sf_dir):
    """Relations whose id does not follow from their ends and type."""
    want = F.concat_ws("__", "source_entity_id", "type", "target_entity_id")
    return relation_records(spark, sf_dir).filter(want != F.col("relation_id")).select("record_id", "relation_id", want.alias("expected_id"))


_R = "r as (select distinct on (record_id) * from extracted_entities)"
_RL = "rl as (select distinct on (record_id) * from extracted_relations)"
_E = _R + ", kb as (select distinct on (entity_id) entity_id, name, type from kb_entities), ent as (select * from kb union all select entity_id, m.name, m.type from (select entity_id, min({record_id: record_id, name: name, type: type}) m from r group by 1) where entity_id not in (select entity_id from kb))"
_ED = _E + ", " + _RL + ", ed as (select least(source_entity_id, target_entity_id) u, greatest(source_entity_id, target_entity_id) v, round(sum(coalesce(weight, 1)), 6) weight, count(*) n from rl where source_entity_id <> target_entity_id and source_entity_id in (select entity_id from ent) and target_entity_id in (select entity_id from ent) group by 1, 2)"
_DG = _ED + ", dg as (select ent.*, coalesce(degree, 0) degree from ent left join (select entity_id, count(*) degree from (select u entity_id from ed union all select v from ed) group by 1) using (entity_id))"
_NAMES = "nm as (select record_id, coalesce(s.name, source_entity_id) source_name, coalesce(s.type, '') source_type, coalesce(t.name, target_entity_id) target_name, coalesce(t.type, '') target_type from rl left join ent s on s.entity_id = source_entity_id left join ent t on t.entity_id = target_entity_id)"
SQL = {
    "jon04_relation_names": f"with {_E}, {_RL}, {_NAMES} select * from nm",
    "jon06_relations_among_names": f"with {_E}, {_RL}, {_NAMES}, x as (select distinct e.name from (select unnest(entities) e from graph_contexts) where e.name is not null) select record_id, source_name, target_name from nm where source_name in (from x) and target_name in (from x)",
    "jon07_resolved_ends": f"with {_R}, {_RL}, k as (select lower(entity_id) ref, 0 o, entity_id from r union all select lower(trim(name)), 1, entity_id from r union all select lower(trim(a)), 2, entity_id from (select unnest(aliases) a, entity_id from r)), m as (select * from (select *, row_number() over (partition by ref order by o, entity_id) n from k where ref <> '') where n = 1), ends as (select record_id, 'source' side, lower(trim(source_entity_id)) ref from rl union all select record_id, 'target', lower(trim(target_entity_id)) from rl) select record_id, side, entity_id, ['id', 'name', 'alias'][o + 1] \"by\" from ends join m using (ref) where ref <> ''",
    "jon09_documents_without_entities": "select distinct doc_id from kb_documents where doc_id not in (select regexp_replace(chunk_id, '_chunk_[0-9]+$', '') from extracted_entities where chunk_id is not null)",
    "jon10_orphan_entities": f"with {_DG} select entity_id, name, type from dg where degree = 0",
    "jon11_overlap": f"with {_R}, n as (select distinct unnest(source_chunk_ids) c from graph_contexts) select distinct entity_id from (select entity_id, unnest(source_chunk_ids) c from r) where c in (select c from n where c is not null)",
    "jon12_containment": "select distinct cache_key, doc_id from (select cache_key, unnest(source_doc_ids) doc_id from query_cache) where doc_id in (select doc_id from kb_documents where deleted_at is not null)",
    "jon15_neighbours": f"with {_ED}, b as (select u, v from ed union all select v, u from ed), s as (select entity_id from ent where type = 'LicenseTerm'), d1 as (select distinct v entity_id from b where u in (from s) and v not in (from s)), d2 as (select distinct v entity_id from b where u in (from d1) and v not in (from s) and v not in (from d1)) select entity_id, 1 distance from d1 union all select entity_id, 2 from d2",
    "agg09_counts": f"with {_R} select count(*) n, count(distinct name) n_names, count(distinct (name, type)) n_name_types, count(distinct nullif(trim(canonical_key), '')) n_keys, count(distinct split_part(chunk_id, '_chunk_', 1)) n_docs from r",
    "agg10_type_shares": f"with {_R} select type, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double \"share\" from r group by 1",
    "agg11_degree_stats": f"with {_DG} select min(degree) least, max(degree) most, round(avg(degree), 6) mean, round(quantile_cont(degree, 0.5), 6) p50, round(quantile_cont(degree, 0.9), 6) p90, round(quantile_cont(degree, 0.99), 6) p99, round(stddev_samp(degree), 6) sd from dg",
    "agg12_orphan_rate": f"with {_DG} select type, count(*) n, count(*) filter (degree = 0) n_orphans, round(count(*) filter (degree = 0) / count(*), 6) rate from dg group by 1",
    "agg13_name_lengths": f"with {_DG} select case when length(name) <= 5 then '1-5' when length(name) <= 10 then '6-10' when length(name) <= 20 then '11-20' when length(name) <= 30 then '21-30' when length(name) <= 50 then '31-50' else '51+' end bucket, count(*) filter (degree = 0) n_orphans, count(*) filter (degree > 0) n_connected, min(length(name))::int least, max(length(name))::int most, round(avg(length(name)), 6) mean, (list_sort(list(length(name)) filter (name is not null)))[count(name) // 2 + 1]::int median from dg group by 1",
    "agg14_common_names": f"with {_R} select name, count(*) n from r group by 1 order by n desc, name limit 20",
    "agg24_cross_referenced": f"with {_R}, x as (select entity_id, count(distinct c) n from (select entity_id, unnest(source_chunk_ids) c from r) where trim(c) <> '' group by 1), o as (select entity_id, max(coalesce(length(trim(description)), 0)) d, max(case when not isnan(confidence) and confidence between 0 and 1 then confidence end) conf from r group by 1) select count(*) filter (n > 1) n_cross_referenced, count(*) filter (d = 0) n_undescribed, count(*) filter (coalesce(conf, 0) < 0.5) n_doubtful, count(*) n_entities from o left join x using (entity_id)",
    "top07_hubs": f"with {_DG} select entity_id, name, degree from dg order by degree desc, entity_id limit 25",
    "grf05_edges": f"with {_ED} select * from ed",
    "grf10_prune": f"with {_R}, dead as (select distinct doc_id || '_chunk_' || chunk_index c from kb_chunks where doc_id in (select doc_id from kb_documents where deleted_at is not null)), x as (select record_id, unnest(case when source_chunk_ids is null or len(source_chunk_ids) = 0 then [null] else source_chunk_ids end) c from r), g as (select record_id, count(c) n, count(*) filter (c in (select c from dead)) n_hit from x group by 1) select * from (select record_id, case when n = n_hit then 'delete' when n_hit > 0 then 'prune' end action, n - n_hit n_left from g) where action is not null",
    "grf11_orphan_relations": f"with {_E}, {_RL} select record_id from rl where source_entity_id is null or target_entity_id is null or source_entity_id not in (select entity_id from ent) or target_entity_id not in (select entity_id from ent) or coalesce(len(source_chunk_ids), 0) <= 0",
    "grf12_noise_orphans": f"with {_DG}, x as (select type, {NOISE_SQL} noise from (select type, lower(trim(coalesce(name, ''))) n from dg where degree = 0)) select type, count(*) filter (noise <> 'sound') n_noise, count(*) n_orphans from x group by 1",
    "grf13_scorecard": f"with {_DG}, a as (select count(*) n_entities, count(*) filter (degree = 0) n_orphans from dg), b as (select count(*) n_edges from ed) select n_entities, n_edges, round(n_edges / n_entities, 6) ratio, round(n_orphans / n_entities * 100, 6) orphan_rate from a, b",
    "hsh01_relation_ids": f"with {_RL} select record_id, relation_id, concat_ws('__', source_entity_id, type, target_entity_id) expected_id from rl where concat_ws('__', source_entity_id, type, target_entity_id) <> relation_id",
}
QUERIES = {n: globals()[n] for n in [*SQL, "grf06_communities", "grf07_parents", "grf08_inner_relations", "snk08_membership", "top06_communities", "grf05_components"]}
SQL = {k: v for k, v in SQL.items() if v}
