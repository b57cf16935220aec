"""Best representative of each group of records that describe one entity.

The survivor is built field by field: the description that states most facts, the best valid confidence, and the
union of true aliases and chunk ids. Equal values are settled by the latest record. Where a record has no
timestamp its place in time is inferred by currency rules: from the groups whose records have timestamps we learn which
value of an attribute comes before which (votes of all pairs of values, cycles broken at their weakest vote, closed over
chains). A record precedes another of its group if every attribute's value precedes or equals the other's and one
precedes: a partial order. An undated record counts as late as the latest dated record that does not follow it, and
among those of one time the topologically later one wins.

Records with equal values of all attributes share a place, so a group is gathered as its few different combinations;
every step before that is an aggregate that starts on the map side, so a group may hold any part of the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.skew import heavy_split_join
from weftline.session import SPACE, pick, strip, table

# fixed values: what stands in for a missing value
STAND_INS = [
    "n/a", "na", "n.a.", "n_a", "none", "null", "nil", "nan", "unknown", "undefined", "missing", "empty", "tbc", "tbd", "todo", "tba", "?", "??", "???",
    "-", "--", "—", "–", "_", ".", "...", "…", "x", "xx", "xxx", "(none)", "[none]", "<none>", "not available", "not applicable", "no alias", "no name", "see source",
]
# fixed values: phrases of sentences that say nothing about the entity
BOILERPLATE = [
    "all rights reserved", "knowledge base", "original document", "source chunk", "nightly job", "computed by the model", "report errors", "pending review",
    "approved by an editor", "to be replaced", "no description", "description is not available", "not available", "lorem ipsum", "automatically generated", "this entry was created", "{{", "}}",
]


def facts(description: Column | str) -> Column:
    """The different complete sentences of a description, in lower case, without markup, stand-ins and boilerplate.
    A sentence is complete if it ends with its own full stop (an ellipsis alone is a cut). Null gives an empty array."""
    c = F.col(description) if isinstance(description, str) else description
    text = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"&[a-zA-Z]+;|&#[0-9]+;", " ")
    text = strip(F.regexp_replace(text, SPACE + "+", " "))
    parts = F.transform(F.split(text, r"(?<=[.!?…]) (?=[\p{Lu}\p{N}{])(?<!\bNo\. )"), lambda s: F.lower(strip(s)))
    noise = "|".join(r"\Q" + p + r"\E" for p in BOILERPLATE)
    whole = F.filter(parts, lambda s: s.rlike(r"[^.…!?\s][^.…]*(?<![.…])[.!?](\.{3}|…)?$") & ~s.rlike(noise) & ~F.regexp_replace(s, r"[.!?]+$", "").isin(STAND_INS))
    return F.coalesce(F.array_distinct(F.transform(whole, lambda s: F.regexp_replace(s, r"(\.{3}|…)$", ""))), F.array().cast("array<string>"))


def clean_items(c: Column | str, lower: bool, stand_ins: bool) -> Column:
    """Elements without surrounding white space, not blank, distinct; an empty array for null."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.transform(c, lambda s: F.lower(strip(s)) if lower else strip(s))
    keep = F.filter(x, lambda s: s.isNotNull() & (s != "") & (~F.lower(s).isin(STAND_INS) if stand_ins else F.lit(True)))
    return F.coalesce(F.array_distinct(keep), F.array().cast("array<string>"))


def currency_values() -> list[Column]:
    """The attributes whose values show age, each with few values: the extractor, the form of the key, whether deleted."""
    key = F.col("canonical_key")
    form = F.when(key.isNull() | F.lower(key).isin([*STAND_INS, "entity", ""]), "useless").when(key.rlike("^[a-z]+:"), "typed").when(key.contains("_"), "slug").otherwise("plain")
    pair = lambda name, v: F.struct(F.lit(name).alias("attr"), F.coalesce(v.cast("string"), F.lit("")).alias("value"))
    return [pair("extractor", F.col("extractor")), pair("key_form", form), pair("deleted", F.col("deleted_at").isNotNull())]


def break_cycles(votes: pd.DataFrame) -> pd.DataFrame:
    """votes: attr, a, b, score (groups in which a came first less those in which b did), one attribute. Result: attr, a,
    b: the pairs of an order without cycles, closed over chains. Pairs enter by falling score, and one that would close a
    cycle with those before it is left out; equal scores enter by name."""
    after: dict[str, set[str]] = {}
    order = sorted(zip(-votes["score"], votes["a"], votes["b"]))
    for _, a, b in order:
        if a == b or a in after.get(b, ()):
            continue
        later = {b} | after.get(b, set())
        for v in [a, *(v for v, ws in after.items() if a in ws)]:
            after.setdefault(v, set()).update(later)
    rows = sorted((a, b) for a, bs in after.items() for b in bs)
    return pd.DataFrame({"attr": [votes["attr"].iloc[0]] * len(rows), "a": [r[0] for r in rows], "b": [r[1] for r in rows]})


def learn_precedence(dated: DataFrame) -> DataFrame:
    """dated: entity_id, updated_at, marks (array of attr, value). Result: attr, a, b: value a comes before value b. In
    each group every pair of values of an attribute has a vote for the one that is seen first; a majority makes a rule.
    Ties and groups with one value teach nothing; without any dated group the result is empty. The values of an
    attribute are few, so the votes are a small table whatever the number of records."""
    first = dated.select("entity_id", "updated_at", F.inline("marks")).groupBy("entity_id", "attr", "value").agg(F.min("updated_at").alias("at"))
    seen = first.groupBy("entity_id", "attr").agg(F.collect_list(F.struct("at", "value")).alias("seq")).filter(F.size("seq") > 1)
    pairs = seen.select("attr", F.explode("seq").alias("x"), "seq").select("attr", F.col("x.value").alias("a"), F.inline(F.transform(F.filter("seq", lambda y: y["at"] > F.col("x.at")), lambda y: F.struct(y["value"].alias("b")))))
    votes = pairs.groupBy("attr", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    back = votes.select("attr", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("against"))
    scored = votes.join(back, ["attr", "a", "b"], "left").select("attr", "a", "b", (F.col("n") - F.coalesce("against", F.lit(0))).alias("score")).filter("score > 0")
    return scored.groupBy("attr").applyInPandas(break_cycles, "attr string, a string, b string")


def place_undated(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """entity_id, marks, as_of, level, n_rows for every combination of values (marks) of which a group has undated
    records. as_of: time of the latest dated record that precedes it or has the same values; if dated records that follow it are
    older than that (dates and rules then form a cycle) only what precedes those counts. level: how many other combinations of the group
    precede this one, so that it rises along the order."""
    known = rules.select(F.concat_ws("\x00", "attr", "a", "b").alias("rule")).agg(F.collect_set("rule").alias("rules"))  # one row, also without rules
    undated = F.col("updated_at").isNull()
    kinds = rows.groupBy("entity_id", "marks").agg(F.min("updated_at").alias("lo"), F.max("updated_at").alias("hi"), F.sum(undated.cast("int")).alias("n_undated"))
    groups = kinds.groupBy("entity_id").agg(F.collect_list(F.struct("marks", "lo", "hi", "n_undated")).alias("kinds"), F.sum("n_undated").alias("n")).filter("n > 0").crossJoin(F.broadcast(known))
    same_or_before = lambda s, t: F.forall(
        F.zip_with(s, t, lambda x, y: (x["value"] == y["value"]) | F.array_contains(F.col("rules"), F.concat_ws("\x00", x["attr"], x["value"], y["value"]))), lambda ok: ok
    )
    each = groups.select("entity_id", "rules", "kinds", F.explode(F.filter("kinds", lambda k: k["n_undated"] > 0)).alias("t"))
    each = each.withColumn("below", F.filter("kinds", lambda s: same_or_before(s["marks"], F.col("t.marks")))).withColumn("above", F.filter("kinds", lambda s: same_or_before(F.col("t.marks"), s["marks"]) & (s["marks"] != F.col("t.marks"))))
    end = F.array_min(F.transform("above", lambda s: s["lo"]))
    times = F.filter(F.flatten(F.transform("below", lambda s: F.array(s["hi"], s["lo"]))), lambda h: h.isNotNull() & (F.col("end").isNull() | (h < F.col("end"))))
    return each.withColumn("end", end).select("entity_id", F.col("t.marks").alias("marks"), F.array_max(times).alias("as_of"), (F.size("below") - 1).alias("level"), F.col("t.n_undated").alias("n_rows"))


def with_currency(records: DataFrame) -> DataFrame:
    """Adds as_of (timestamp) and level (int) to records with entity_id, updated_at, extractor, canonical_key and
    deleted_at. Dated records keep their updated_at and have level 0, undated ones get those of place_undated. An entity_id must not be null."""
    marks = F.array(*currency_values())
    thin = records.select("entity_id", "updated_at", marks.alias("marks"))
    placed = place_undated(thin, learn_precedence(thin.filter("updated_at is not null")))
    dated = records.filter("updated_at is not null").withColumn("as_of", F.col("updated_at")).withColumn("level", F.lit(0))
    undated = records.filter("updated_at is null").withColumn("marks", marks)
    late = heavy_split_join(undated, placed.drop("n_rows"), ["entity_id", "marks"], placed.select("entity_id", "marks", "n_rows"))
    return dated.unionByName(late.drop("marks"))


_COLUMNS = ["record_id", "entity_id", "name", "canonical_key", "description", "aliases", "confidence", "source_chunk_ids", "extractor", "updated_at", "deleted_at"]


def surviving_records(records: DataFrame) -> DataFrame:
    """entity_id, description_record, confidence_record, confidence, n_rows for every entity with two different
    record ids or more. Only numbers are gathered, no text. A record repeated in all columns counts once. Null
    entity ids form no group."""
    rows = with_currency(pick(records, *_COLUMNS).filter("entity_id is not null"))
    valid = F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0)
    rows = rows.select("entity_id", "record_id", "as_of", "level", F.size(facts("description")).alias("n_facts"), F.when(valid, F.col("confidence")).alias("sure"))
    recent = [F.col("as_of").alias("r0"), F.col("level").alias("r1"), (-F.col("record_id")).alias("r2"), F.col("record_id").alias("id")]
    told, sure = F.struct(F.col("n_facts").alias("n"), *recent), F.when(F.col("sure").isNotNull(), F.struct(F.col("sure").alias("n"), *recent))
    best = rows.groupBy("entity_id").agg(F.max(told).alias("d"), F.max(sure).alias("c"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    return best.filter("lo < hi").select("entity_id", F.col("d.id").alias("description_record"), F.col("c.id").alias("confidence_record"), F.col("c.n").alias("confidence"), "n_rows")


def survivors(records: DataFrame) -> DataFrame:
    """surviving_records with the description itself."""
    texts = pick(records, "entity_id", "record_id", "description").dropDuplicates(["entity_id", "record_id"]).withColumnRenamed("record_id", "description_record")
    return surviving_records(records).join(texts, ["entity_id", "description_record"])


def surviving_items(records: DataFrame) -> DataFrame:
    """entity_id, field_name (aliases or source_chunk_ids), item: distinct, for entities with two record ids or more.
    An alias equal to a name of its entity, a blank or a stand-in is none. Null arrays and elements add nothing."""
    rows = pick(records, "record_id", "entity_id", "name", "aliases", "source_chunk_ids").filter("entity_id is not null")
    item = lambda f, x: F.transform(x, lambda s: F.struct(F.lit(f).alias("field_name"), s.alias("item")))
    name = F.filter(F.array(F.lower(strip("name"))), lambda s: s.isNotNull())
    items = rows.select("entity_id", "record_id", F.inline(F.concat(item("aliases", clean_items("aliases", True, True)), item("source_chunk_ids", clean_items("source_chunk_ids", False, False)), item("name", name), F.array(F.struct(F.lit("record").alias("field_name"), F.lit("").alias("item"))))))
    one = items.groupBy("entity_id", "field_name", "item").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
    several = one.filter("field_name = 'record' and lo < hi").select("entity_id")
    names = one.filter("field_name = 'name'").select("entity_id", F.lit("aliases").alias("field_name"), "item")
    return one.filter("field_name in ('aliases', 'source_chunk_ids')").join(several, "entity_id", "left_semi").join(names, ["entity_id", "field_name", "item"], "left_anti").select("entity_id", "field_name", "item")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, field_name, item."""
    records = table(spark, sf_dir, "extracted_entities")
    best = surviving_records(records).select(
        "entity_id",
        F.inline(F.array(F.struct(F.lit("description").alias("field_name"), F.col("description_record").cast("string").alias("item")), F.struct(F.lit("confidence").alias("field_name"), F.col("confidence_record").cast("string").alias("item")))),
    )
    return best.filter("item is not null").unionByName(surviving_items(records))


def p5_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned precedence of values: attr, value, level (how many values come before it)."""
    rows = pick(table(spark, sf_dir, "extracted_entities"), *_COLUMNS).filter("entity_id is not null and updated_at is not null")
    rules = learn_precedence(rows.withColumn("marks", F.array(*currency_values())))
    return rules.select("attr", F.inline(F.array(F.struct(F.col("a").alias("value"), F.lit(0).alias("n")), F.struct(F.col("b").alias("value"), F.lit(1).alias("n"))))).groupBy("attr", "value").agg(F.sum("n").alias("level"))


def p5_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the survivor is still found when the timestamps of a tenth of the records (by the hash of their id) are
    hidden: field_name, n_entities (that have a hidden record), n_same."""
    records = pick(table(spark, sf_dir, "extracted_entities"), *_COLUMNS)
    hide = F.pmod(F.xxhash64(F.lit(17), "record_id"), F.lit(10)) == 0
    touched = records.filter(hide & F.col("entity_id").isNotNull()).select("entity_id").distinct()
    true = surviving_records(records).join(touched, "entity_id", "left_semi")
    told = surviving_records(records.withColumn("updated_at", F.when(~hide, F.col("updated_at")))).select("entity_id", F.col("description_record").alias("d"), F.col("confidence_record").alias("c"))
    field = lambda name, a, b: F.struct(F.lit(name).alias("field_name"), a.isNotNull().cast("int").alias("n"), F.coalesce((a == b).cast("int"), F.lit(0)).alias("same"))
    both = true.join(told, "entity_id").select(F.inline(F.array(field("description", F.col("description_record"), F.col("d")), field("confidence", F.col("confidence_record"), F.col("c")))))
    return both.groupBy("field_name").agg(F.sum("n").alias("n_entities"), F.sum("same").alias("n_same"))


_Q = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_TEXT = _STRIP(rf"regexp_replace(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '{_WS}+', ' ', 'g')")
_SPLIT = rf"string_split(replace(regexp_replace(replace({_TEXT}, 'No. ', 'No.@@'), '([.!?…]) ([\p{{Lu}}\p{{N}}{{])', '\1##\2', 'g'), 'No.@@', 'No. '), '##')"
_NOISE = " or ".join(f"contains(s, '{p}')" for p in BOILERPLATE)
SQL = {
    "p5_found": rf"""
with r as (select distinct record_id, entity_id, name, description, aliases, confidence, source_chunk_ids, updated_at from extracted_entities where entity_id is not null),
several as (select entity_id from r group by 1 having count(distinct record_id) > 1),
parts as (select record_id, lower({_STRIP('unnest(' + _SPLIT + ')')}) s from r where description is not null),
told as (select record_id, count(distinct regexp_replace(s, '(\.\.\.|…)$', '')) n from parts
  where regexp_matches(s, '[^.…!?\s][^.…]*[^.…][.!?](\.\.\.|…)?$') and not ({_NOISE}) and regexp_replace(s, '[.!?]+$', '') not in ({_Q(STAND_INS)}) group by 1),
best as (select entity_id, record_id, confidence,
  row_number() over (partition by entity_id order by coalesce(n, 0) desc, updated_at desc, record_id) d,
  row_number() over (partition by entity_id order by case when confidence between 0 and 1 and not isnan(confidence) then confidence end desc nulls last, updated_at desc, record_id) c
  from r left join told using (record_id)),
names as (select distinct entity_id, lower({_STRIP('name')}) item from r),
al as (select entity_id, lower({_STRIP('unnest(aliases)')}) item from r)
select entity_id, 'description' field_name, record_id::varchar item from best where d = 1 and entity_id in (from several)
union all select entity_id, 'confidence', record_id::varchar from best where c = 1 and confidence between 0 and 1 and not isnan(confidence) and entity_id in (from several)
union all select distinct entity_id, 'aliases', item from al where item <> '' and item not in ({_Q(STAND_INS)}) and entity_id in (from several) and (entity_id, item) not in (select (entity_id, item) from names where item is not null)
union all select distinct entity_id, 'source_chunk_ids', item from (select entity_id, {_STRIP('unnest(source_chunk_ids)')} item from r) where item <> '' and entity_id in (from several)
"""
}
QUERIES = {"p5_found": p5_found, "p5_currency": p5_currency, "p5_hidden": p5_hidden}
