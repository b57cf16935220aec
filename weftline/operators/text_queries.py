"""Projections, filters and text functions over documents, chunks, entities and cached answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.retrieval import live_chunks, live_documents
from weftline.session import pick, table


def _docs(spark, sf_dir):
    return pick(table(spark, sf_dir, "documents"), "doc_id", "text", "title", "lang", "source")


def fil01_strict_citation(spark, sf_dir):
    ck = live_chunks(spark, sf_dir, "doc_id", "citation_url", "citation_title", "citation_year", "citation_month", "page_start", "section_id", "anchor_id")
    cited = F.col("citation_url").isNotNull() & F.col("citation_title").isNotNull() & F.col("citation_year").isNotNull() & F.col("citation_month").isNotNull()
    return ck.filter(cited & (F.col("page_start").isNotNull() | F.col("section_id").isNotNull() | F.col("anchor_id").isNotNull())).select("chunk_id", "doc_id", "citation_year", "citation_month")


def fil02_equality(spark, sf_dir):
    return live_documents(spark, sf_dir, "category", "lang", "source_type").filter("category = 'faq' and lang = 'en' and source_type = 'crawler'").select("doc_id", "category", "lang", "source_type")


def fil03_year_month_range(spark, sf_dir):
    return live_chunks(spark, sf_dir, "citation_year", "citation_month").filter(F.col("citation_year").between(2018, 2022) & F.col("citation_month").between(1, 6)).select("chunk_id", "citation_year", "citation_month")


def fil06_clean_chunks(spark, sf_dir):
    """Chunks that read as prose."""
    ck = live_chunks(spark, sf_dir, "chunk_text", "citation_url")
    return ck.filter(T.is_clean(F.col("chunk_text"), F.col("citation_url"))).select("chunk_id", F.regexp_count("chunk_text", F.lit("[.?!]")).alias("n_ends"))


def fil07_noise_class(spark, sf_dir):
    rows = pick(table(spark, sf_dir, "extracted_entities"), "record_id", "name").distinct()
    return rows.groupBy(F.coalesce(T.noise_class(F.col("name")), F.lit("sound")).alias("noise")).agg(F.count(F.lit(1)).alias("n"))


def fil08_self_relations(spark, sf_dir):
    """Relations whose ends are both known entities and not the same."""
    rel = pick(table(spark, sf_dir, "extracted_relations"), "record_id", "source_entity_id", "target_entity_id").distinct()
    ids = pick(table(spark, sf_dir, "extracted_entities"), "entity_id").unionByName(pick(table(spark, sf_dir, "kb_entities"), "entity_id")).distinct()
    ends = rel.filter("source_entity_id <> target_entity_id").join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi")
    return ends.join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi").select("record_id", "source_entity_id", "target_entity_id")


def fil09_suspicious_ids(spark, sf_dir):
    """Ends of relations whose id was made up: a letter e and a number, or a rule's name."""
    r = pick(table(spark, sf_dir, "extracted_relations"), "record_id", "source_entity_id", "target_entity_id").distinct()
    ends = r.select("record_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    return ends.groupBy(F.when(F.col("entity_id").rlike("^e[0-9]+$"), "numbered").when(F.col("entity_id").rlike("^rule_"), "rule").when(F.col("entity_id").rlike("^[0-9a-f]{16}$"), "digest").otherwise("other").alias("form")).agg(F.count(F.lit(1)).alias("n_ends"))


# fixed values: parts of addresses with their category, the first that occurs counts
URL_CATEGORIES = {"/news/": "news", "/events/": "events", "/awards/": "awards"}


def fil10_url_category(spark, sf_dir):
    """Documents by category of their address (pages if no pattern occurs) and year and month of the last change."""
    u, kind = F.col("source_uri"), F.lit("pages")
    for part, name in reversed(URL_CATEGORIES.items()):
        kind = F.when(u.contains(part), name).otherwise(kind)
    d = live_documents(spark, sf_dir, "source_uri", "updated_at").withColumn("lastmod", F.date_format("updated_at", "yyyy-MM-dd"))
    return d.groupBy(kind.alias("url_category"), F.substring("lastmod", 1, 4).cast("int").alias("year"), F.substring("lastmod", 6, 2).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def fil11_contains(spark, sf_dir):
    return pick(table(spark, sf_dir, "extracted_entities"), "entity_id", "name").distinct().filter(F.contains(F.lower("name"), F.lit("choral"))).select("entity_id", "name")


def fil12_row_errors(spark, sf_dir):
    """Evaluation rows with the list of what is missing in them."""
    a = pick(table(spark, sf_dir, "agent_eval_example"), "id", "prompt", "reference", "reference_urls", "metadata").dropDuplicates(["id"])
    miss = lambda c, name: F.when(c.isNull(), F.lit(name))
    blank = lambda c: F.when(F.trim(c) != "", c)
    errors = F.concat_ws(",", miss(blank(F.col("prompt")), "prompt"), miss(blank(F.col("reference")), "reference"), miss(F.col("reference_urls"), "urls"), miss(F.col("metadata.category"), "category"))
    return a.select("id", errors.alias("errors")).filter("errors <> ''")


def prj02_defaults(spark, sf_dir):
    d = live_documents(spark, sf_dir, "category", "lang", "source_type", "published_year", "published_month")
    low = F.lower(F.trim("lang"))
    return d.select("doc_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce(low, F.lit("unknown")).alias("lang"), F.coalesce("source_type", F.lit("crawler")).alias("source_type"), F.coalesce("published_year", F.lit(1970)).alias("year"), F.coalesce("published_month", F.lit(1)).alias("month"))


def prj03_safe_json(spark, sf_dir):
    """Year and month of the metadata; bad JSON counts as an empty object."""
    d = live_documents(spark, sf_dir, "metadata").withColumn("v", F.try_parse_json("metadata"))
    get = lambda p: F.try_cast(F.try_variant_get("v", p, "string"), "int") if hasattr(F, "try_cast") else F.try_variant_get("v", p, "string").try_cast("int")
    return d.select("doc_id", get("$.year").alias("year"), get("$.month").alias("month"), F.col("v").isNull().alias("bad"))


def prj04_citations(spark, sf_dir):
    return live_chunks(spark, sf_dir, "citation_title", "citation_url", "chunk_text").select("chunk_id", F.col("citation_title").alias("title"), F.col("citation_url").alias("url"), F.substring("chunk_text", 1, 280).alias("snippet"))


def prj07_composite_ids(spark, sf_dir):
    return live_chunks(spark, sf_dir, "doc_id", "chunk_index").select("chunk_id", F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("composite_id"))


def str01_slugs(spark, sf_dir):
    return live_documents(spark, sf_dir, "title").select("doc_id", T.slugify(F.col("title")).alias("slug"))


def str02_token_counts(spark, sf_dir):
    return live_chunks(spark, sf_dir, "doc_id", "chunk_text").groupBy("doc_id").agg(F.sum(T.token_count(F.col("chunk_text"))).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"))


def str03_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


def str04_token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(F.floor(F.length("text") / 4)).alias("n_tokens"))


# fixed values: forms of identifiers and dates in a text, by label
IDENTIFIERS = {"ISWC": r"\bT-?[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]\b", "ISRC": r"\b[A-Z]{2}-?[A-Za-z0-9_]{3}-?[0-9]{2}-?[0-9]{5}\b"}
DATES = [r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b", r"\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s+[0-9]{4}\b"]


def str05_codes(spark, sf_dir):
    """Identifiers and dates in the texts, each once a document and label, with the canonical spelling and the first place."""
    every = [*IDENTIFIERS.items(), *(("DATE", d) for d in DATES)]
    labelled = lambda k, r: F.transform(F.regexp_extract_all("text", F.lit(f"({r})"), F.lit(1)), lambda v: F.struct(F.lit(k).alias("label"), v.alias("code")))
    found = F.flatten(F.array(*[labelled(k, r) for k, r in every]))
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.explode(F.array_distinct(found)).alias("x"))
    return rows.select("doc_id", "x.label", "x.code", F.translate("x.code", "-.", "").alias("canonical_key"), F.expr("instr(text, x.code)").alias("place"))


def str06_clean_text(spark, sf_dir):
    return live_chunks(spark, sf_dir, "chunk_text").select("chunk_id", F.md5(T.clean_text(F.col("chunk_text"))).alias("digest"))


def str08_url_parts(spark, sf_dir):
    u = F.col("source_uri")
    stem = F.regexp_replace(F.element_at(F.split(u, "/"), -1), r"\.[^.]+$", "")
    return live_documents(spark, sf_dir, "source_uri").select("doc_id", stem.alias("stem"), F.regexp_extract(u, r"\.([a-z]+)$", 1).alias("extension"))


def str12_plain_names(spark, sf_dir):
    return pick(table(spark, sf_dir, "extracted_entities"), "record_id", "canonical_key").distinct().select("record_id", T.plain_name(F.col("canonical_key")).alias("plain"))


def hsh01_stable_ids(spark, sf_dir):
    e = pick(table(spark, sf_dir, "extracted_entities"), "record_id", "name", "canonical_key", "type").distinct()
    return e.select("record_id", T.stable_id(F.coalesce(F.nullif("canonical_key", F.lit("")), F.lower("name")), F.col("type")).alias("stable_id"))


def hsh02_cache_keys(spark, sf_dir):
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "query_original", "query_rewritten").distinct()
    return q.select("cache_key", T.cache_key(F.col("query_rewritten"), F.col("query_original")).alias("computed_key"))


def jsn01_citation_sources(spark, sf_dir):
    """Sources cited by each cached answer, whose citations are taken out of prose and fences; bad JSON cites nothing."""
    prose = F.concat(F.lit("Here are the sources:\n```json\n"), F.col("citations"), F.lit("\n```\nI hope this helps."))
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "citations").distinct().select("cache_key", T.json_part(prose).alias("part")).filter(F.try_parse_json("part").isNotNull())
    items = F.from_json("part", "array<struct<sourceId:string,title:string>>")
    return q.select("cache_key", F.explode(items).alias("c")).filter("c.sourceId is not null").groupBy(F.col("c.sourceId").alias("doc_id")).agg(F.countDistinct("cache_key").alias("n_answers"))


def jsn02_layers(spark, sf_dir):
    """Citations parsed in layers: the whole, else the part between brackets, else every object that is valid by itself."""
    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "citations").dropDuplicates(["cache_key"]).filter("citations is not null")
    n_items = F.size(T.json_objects(F.col("citations")))
    layer = F.when(F.try_parse_json("citations").isNotNull(), "direct").when(F.try_parse_json(T.json_part(F.col("citations"))).isNotNull(), "part").when(n_items > 0, "items").otherwise("none")
    return q.select("cache_key", layer.alias("layer"), n_items.alias("n_items"))


def set02_keyword_union(spark, sf_dir):
    """Different words of the original and the rewritten query, in order of appearance."""
    from weftline.operators.retrieval import terms

    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "query_original", "query_rewritten").distinct()
    return q.select("cache_key", F.array_join(F.array_distinct(F.concat(terms("query_original"), terms("query_rewritten"))), " ").alias("words"))


def set04_token_jaccard(spark, sf_dir):
    from weftline.operators.retrieval import terms

    q = pick(table(spark, sf_dir, "query_cache"), "cache_key", "query_original", "answer").distinct()
    a, b = F.array_distinct(terms("query_original")), F.array_distinct(terms("answer"))
    return q.select("cache_key", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0)), 6).alias("jaccard"))


def top08_hash_sample(spark, sf_dir):
    """Three documents of each category in the order of a seeded hash."""
    from pyspark.sql import Window

    d = live_documents(spark, sf_dir, "category").withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("doc_id"))))
    w = Window.partitionBy("category").orderBy("h", "doc_id")
    return d.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("category", "doc_id", "n")


_CK = "ck as (select distinct on (chunk_id) * from kb_chunks where deleted_at is null)"
_D = "d as (select distinct on (doc_id) * from kb_documents where deleted_at is null)"
_TERMS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_LIST = lambda ws: ", ".join(f"'{w}'" for w in ws)
_CLOCK = "[0-9]{1,2}:[0-9]{2}\\s*(?:am|pm)?"
NOISE_SQL = f"""case when n = '' then 'empty' when length(n) = 1 then 'single_char' when n in ({_LIST(T.PRONOUNS)}) then 'pronoun' when n in ({_LIST(T.ARTICLES)}) then 'article'
  when n in ({_LIST(T.GENERIC_TERMS)}) then 'generic_term' when regexp_matches(n, '^{_CLOCK}(?:\\s*-\\s*{_CLOCK})?$') then 'time_fragment' when regexp_matches(n, '^[0-9]+(?:\\.[0-9]+)?%?$') then 'pure_number'
  when regexp_matches(n, '^[0-9]+(?:st|nd|rd|th)$') then 'ordinal' else 'sound' end"""
SQL = {
    "fil01_strict_citation": f"with {_CK} select chunk_id, doc_id, citation_year, citation_month from ck where citation_url is not null and citation_title is not null and citation_year is not null and citation_month is not null and (page_start is not null or section_id is not null or anchor_id is not null)",
    "fil02_equality": f"with {_D} select doc_id, category, lang, source_type from d where category = 'faq' and lang = 'en' and source_type = 'crawler'",
    "fil03_year_month_range": f"with {_CK} select chunk_id, citation_year, citation_month from ck where citation_year between 2018 and 2022 and citation_month between 1 and 6",
    "fil06_clean_chunks": f"with {_CK} select chunk_id, (length(chunk_text) - length(regexp_replace(chunk_text, '[.?!]', '', 'g')))::int n_ends from ck where not regexp_matches(lower(coalesce(citation_url, '')), '/search\\b|[?&]q=|[?&]query=|[?&]search=|/results\\b') and length(trim(chunk_text)) >= 100 and length(chunk_text) - length(replace(chunk_text, '<', '')) <= 10 and (length(chunk_text) - length(replace(chunk_text, 'http', ''))) / 4 <= 5 and length(chunk_text) - length(regexp_replace(chunk_text, '[.?!]', '', 'g')) >= 2 and (length(chunk_text) - length(regexp_replace(lower(chunk_text), '{T.NAVIGATION}', '', 'g'))) / greatest(length(trim(chunk_text)), 1) <= 0.2",
    "fil07_noise_class": f"select {NOISE_SQL} noise, count(*) n from (select lower(trim(coalesce(name, ''))) n from (select distinct record_id, name from extracted_entities)) group by 1",
    "fil08_self_relations": "with ids as (select entity_id from extracted_entities union select entity_id from kb_entities) select distinct record_id, source_entity_id, target_entity_id from extracted_relations where source_entity_id <> target_entity_id and source_entity_id in (from ids) and target_entity_id in (from ids)",
    "fil09_suspicious_ids": "select case when regexp_matches(e, '^e[0-9]+$') then 'numbered' when starts_with(e, 'rule_') then 'rule' when regexp_matches(e, '^[0-9a-f]{16}$') then 'digest' else 'other' end form, count(*) n_ends from (select record_id, unnest([source_entity_id, target_entity_id]) e from (select distinct record_id, source_entity_id, target_entity_id from extracted_relations)) group by 1",
    "fil10_url_category": f"with {_D} select case when contains(source_uri, '/news/') then 'news' when contains(source_uri, '/events/') then 'events' when contains(source_uri, '/awards/') then 'awards' else 'pages' end url_category, year(updated_at)::int as year, month(updated_at)::int as month, count(*) n from d group by 1, 2, 3",
    "fil11_contains": "select distinct entity_id, name from extracted_entities where contains(lower(name), 'choral')",
    "fil12_row_errors": "select * from (select id, concat_ws(',', case when prompt is null or trim(prompt, ' ') = '' then 'prompt' end, case when reference is null or trim(reference, ' ') = '' then 'reference' end, case when reference_urls is null then 'urls' end, case when metadata.category is null then 'category' end) errors from (select distinct on (id) * from agent_eval_example)) where errors <> ''",
    "prj02_defaults": f"with {_D} select doc_id, coalesce(category, 'unknown') category, coalesce(lower(trim(lang)), 'unknown') lang, coalesce(source_type, 'crawler') source_type, coalesce(published_year, 1970) as year, coalesce(published_month, 1) as month from d",
    "prj03_safe_json": f"with {_D} select doc_id, try_cast(case when json_valid(metadata) then json_extract_string(metadata, '$.year') end as int) as year, try_cast(case when json_valid(metadata) then json_extract_string(metadata, '$.month') end as int) as month, metadata is null or not json_valid(metadata) bad from d",
    "prj04_citations": f"with {_CK} select chunk_id, citation_title title, citation_url url, substring(chunk_text, 1, 280) snippet from ck",
    "prj07_composite_ids": f"with {_CK} select chunk_id, doc_id || '_chunk_' || chunk_index composite_id from ck",
    "str01_slugs": f"with {_D} select doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') slug from d",
    "str02_token_counts": f"with {_CK} select doc_id, sum(len(list_filter(string_split_regex(coalesce(chunk_text, ''), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0b}}]+'), lambda x: x <> '')))::bigint n_tokens, count(*) n_chunks from ck group by 1",
    "str03_sentences": "select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1@%@', 'g'), '@%@'), lambda x: x <> ''))::int n_sentences from documents where text is not null",
    "str04_token_estimate": "select source, sum(length(text) // 4)::bigint n_tokens from documents group by 1",
    "str05_codes": "with m as (" + " union ".join(f"select doc_id, text, '{k}' as label, unnest(regexp_extract_all(text, '{r}')) code from documents" for k, r in [*IDENTIFIERS.items(), *(("DATE", d) for d in DATES)]) + ") select doc_id, label, code, translate(code, '-.', '') canonical_key, instr(text, code)::int place from (select distinct doc_id, text, label, code from m)",
    "jsn02_layers": "with q as (select distinct on (cache_key) cache_key, citations c from query_cache where citations is not null), p as (select cache_key, c, list_filter(regexp_extract_all(c, '\\{[^{}]*\\}'), lambda x: json_valid(x)) items, case when regexp_matches(c, '^[^{\\[]*\\{') then regexp_extract(c, '(?s)\\{.*\\}') when regexp_matches(c, '^[^{\\[]*\\[') then regexp_extract(c, '(?s)\\[.*\\]') end part from q) select cache_key, case when json_valid(c) then 'direct' when json_valid(nullif(part, '')) then 'part' when len(items) > 0 then 'items' else 'none' end layer, len(items)::int n_items from p",
    "str06_clean_text": f"with {_CK} select chunk_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chunk_text, '<[^>]+>', ' ', 'g'), '[\\s\\x0b]*[›»>][\\s\\x0b]*', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) digest from ck",
    "str08_url_parts": f"with {_D} select doc_id, regexp_replace(string_split(source_uri, '/')[-1], '\\.[^.]+$', '') stem, regexp_extract(source_uri, '\\.([a-z]+)$', 1) \"extension\" from d",
    "str12_plain_names": "select record_id, trim(replace(lower(canonical_key), '_', ' ')) plain from (select distinct record_id, canonical_key from extracted_entities)",
    "hsh01_stable_ids": "select record_id, substring(sha256(coalesce(nullif(canonical_key, ''), lower(name)) || '::' || type), 1, 16) stable_id from (select distinct record_id, name, canonical_key, type from extracted_entities)",
    "hsh02_cache_keys": "select cache_key, sha256(lower(trim(coalesce(nullif(query_rewritten, ''), query_original)))) computed_key from (select distinct cache_key, query_original, query_rewritten from query_cache)",
    "jsn01_citation_sources": "select doc_id, count(distinct cache_key) n_answers from (select cache_key, unnest(from_json(citations, '[{\"sourceId\":\"VARCHAR\"}]')).sourceId doc_id from query_cache where json_valid(citations)) where doc_id is not null group by 1",
    "set02_keyword_union": f"select cache_key, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') words from (select cache_key, list_concat({_TERMS.format('query_original')}, {_TERMS.format('query_rewritten')}) w from (select distinct cache_key, query_original, query_rewritten from query_cache))",
    "set04_token_jaccard": f"select cache_key, round(coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) jaccard from (select cache_key, list_distinct({_TERMS.format('query_original')}) a, list_distinct({_TERMS.format('answer')}) b from (select distinct cache_key, query_original, answer from query_cache))",
    "top08_hash_sample": f"with {_D} select category, doc_id, n from (select category, doc_id, row_number() over (partition by category order by md5('42:' || doc_id), doc_id) n from d) where n <= 3",
}
QUERIES = {n: globals()[n] for n in SQL}
