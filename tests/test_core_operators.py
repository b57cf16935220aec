import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.vectors import cosine, dense_topk
from weftline.operators import context as C
from weftline.operators import graph as G
from weftline.operators import hits as H
from weftline.operators import ingest as I
from weftline.operators import merge as M
from weftline.operators import retrieval as R
from weftline.operators.skew import hub_join
from weftline.sources import readers as S
from weftline.streaming import pipelines as P


@pytest.mark.parametrize("text,slug", [("Section 1.1: Overview!", "section-11-overview"), ("---heading---", "heading"), ("!!!", "section"), ("", "section"), (None, "section"), ("A  b", "a-b")])
def test_slugify(spark, text, slug):
    assert spark.createDataFrame([(text,)], "t string").select(T.slugify(F.col("t"))).first()[0] == slug


def test_token_count_and_sentences(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.token_count(F.col("t"))).collect()] == [3, 0, 0]
    assert spark.createDataFrame([("One. Two! Three? 3.5 x",)], "t string").select(T.sentences(F.col("t"))).first()[0] == ["One.", "Two!", "Three?", "3.5 x"]


def test_fusion_scores_ties_and_provenance(spark):
    lists = lambda rows: spark.createDataFrame(rows, "qid int, id string, rank int")
    got = [tuple(r) for r in R.rrf([(lists([(1, "c1", 1), (1, "c2", 2)]), 1.0), (lists([(1, "c2", 1)]), 1.0)], 60, 8).orderBy("rank").select("id", "score", "sources").collect()]
    assert got == [("c2", round(1 / 62 + 1 / 61, 9), 3), ("c1", round(1 / 61, 9), 1)]
    tie = R.rrf([(lists([(1, "b", 1)]), 0.5), (lists([(1, "a", 1)]), 0.5)], 60, 1).collect()
    assert [r["id"] for r in tie] == ["a"]
    assert R.rrf([(lists([]), 1.0)], 60, 8).collect() == []


def test_bm25_and_boolean_match_on_empty_and_null_texts(spark):
    docs = spark.createDataFrame([("d1", "wave of rain"), ("d2", None), ("d3", ""), ("d4", "rain rain wave sun")], "id string, text string")
    q = spark.createDataFrame([(1, "Rain wave"), (2, ""), (3, None), (4, "snow")], "qid int, query string")
    docs = docs.withColumn("tf", F.lit(0)).withColumn("dl", F.lit("x")).withColumn("title", F.lit("sun"))
    assert sorted((r["qid"], r["id"]) for r in R.and_match(q, docs, "id", "text").collect()) == [(1, "d1"), (1, "d4")]
    assert {(r["qid"], r["id"]) for r in R.bm25(q, docs, "id", {"text": 1.0}).collect()} == {(1, "d1"), (1, "d4")}
    assert R.and_match(q.limit(0), docs, "id", "text").count() == 0 and R.bm25(q, docs.limit(0), "id", {"text": 1.0}).count() == 0
    among = spark.createDataFrame([("d4",)], "id string")
    assert [r["id"] for r in R.bm25(q, docs, "id", {"text": 1.0}, among=among).collect()] == ["d4"]


def test_bm25_takes_the_best_field(spark, monkeypatch):
    from weftline.functions import vectors as V

    rnd = random.Random(5)
    words = "rain wave sun moon star sea".split()
    rows = [(f"d{i:02d}", " ".join(rnd.choices(words, k=rnd.randint(0, 9))), " ".join(rnd.choices(words, k=rnd.randint(0, 3)))) for i in range(30)]
    qs = [(i, " ".join(rnd.sample(words, rnd.randint(1, 3)))) for i in range(8)]

    def slow(k):
        out = {}
        for qid, q in qs:
            scores = []
            for d in rows:
                best = 0.0
                for f, boost in ((1, 3.0), (2, 2.0)):
                    texts = [r[f].split() for r in rows if r[f]]
                    avg = sum(map(len, texts)) / len(texts)
                    own = d[f].split()
                    s = 0.0
                    for t in set(q.split()):
                        df, tf = sum(t in x for x in texts), own.count(t)
                        if tf:
                            s += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
                    best = max(best, boost * s)
                if best > 0:
                    scores.append((-round(best, 6), d[0]))
            out[qid] = [(i, -s) for s, i in sorted(scores)[:k]]
        return out

    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "ROW_BLOCK", 7)
    docs, q = spark.createDataFrame(rows, "id string, text string, title string"), spark.createDataFrame(qs, "qid int, query string")
    got = {}
    for r in R.bm25(q, docs, "id", {"text": 3.0, "title": 2.0}, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert got == {k: v for k, v in slow(5).items() if v}


def test_cover_density():
    assert R.cover_density([]) == 0 and R.cover_density([[1], []]) == 0
    assert R.cover_density([[3, 8]]) == pytest.approx(0.2)  # every occurrence of one term
    assert R.cover_density([[1], [2]]) == pytest.approx(0.1) and R.cover_density([[1], [5]]) == pytest.approx(0.1 / 4)
    assert R.cover_density([[1, 10], [2]]) == pytest.approx(0.1 + 0.1 / 8)


def test_cosine_and_topk_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, None, None]
    rnd = random.Random(1)
    rows = [(f"r{i:02d}", [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, vec array<float>")
    q = df.select(F.col("id").alias("qid"), "vec")
    from weftline.functions import vectors as V

    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROW_BLOCK", 11)
    a = sorted(tuple(r) for r in dense_topk(q, df, 3).select("qid", "id", "rank").collect())
    monkeypatch.undo()
    assert all(r["qid"] != r["id"] for r in dense_topk(q, df, 1, other=True).collect())
    assert a == sorted(tuple(r) for r in dense_topk(q, df, 3).select("qid", "id", "rank").collect()) and len(a) == 120
    many = q.withColumn("qid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat("qid", F.lit("-"), i.cast("string")))))
    assert dense_topk(many, df, 3).count() == 2400  # more queries than are multiplied at once
    assert dense_topk(q.limit(0), df, 3).count() == 0 and dense_topk(q, df.limit(0), 3).count() == 0


def sections(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, section_no int, text string")


def test_chunker(spark):
    words = lambda n, p="w": " ".join(f"{p}{i}" for i in range(n))
    run = lambda rows, *a: [(r["doc_id"], r["chunk_index"], r["section_no"], r["token_count"]) for r in I.chunk_sections(sections(spark, rows), "doc_id", *a).orderBy("doc_id", "chunk_index").collect()]
    assert run([(1, 1, words(100))], 512, 64, 50) == [(1, 0, 1, 100)]
    assert run([(1, 1, words(50)), (1, 2, words(60)), (1, 3, words(40))], 512, 64, 10) == [(1, 0, 1, 50), (1, 1, 2, 60), (1, 2, 3, 40)]
    assert run([(1, 1, "one two"), (1, 2, "a b c d e"), (1, 3, "x")], 512, 64, 100) == [(1, 0, 2, 5)]
    assert run([(1, 1, ""), (2, 1, None)], 512, 64, 1) == []
    twenty = " ".join(f"{words(9, f's{k}x')} end{k}." for k in range(20))
    assert [n for *_, n in run([(1, 1, twenty)], 30, 0, 1)] == [30] * 6 + [20]


def test_pack_overlap_draws_from_all_words_before():
    chunks = I.pack("a b c. d e f. g h i.", 3, 4)
    assert chunks == ["a b c.", "a b c. d e f.", "c. d e f. g h i."] or [len(c.split()) for c in chunks] == [3, 6, 7]
    assert I.pack("", 3, 1) == [] and I.pack("one very long sentence without an end", 3, 1) == ["one very long sentence without an end"]


def test_sections_of_markdown_and_html(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nx\ny\n## Two\nz"), (2, None), (3, ""), (4, "no heading")], "doc_id int, text string")
    assert [(r["section_no"], r["level"], r["heading"], r["text"]) for r in S.markdown_sections(docs, "doc_id", "text").orderBy("section_no").collect()] == [(1, 1, "One", "x\ny"), (2, 2, "Two", "z")]
    html = spark.createDataFrame([(1, "<title>t</title><h1>A &amp; B</h1><p>x <b>y</b></p><script>bad()</script><h2>C</h2>z"), (2, None)], "doc_id int, text string")
    assert [(r["level"], r["heading"], r["text"]) for r in S.html_sections(html, "doc_id", "text").orderBy("section_no").collect()] == [(1, "A & B", "x y"), (2, "C", "z")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.MD").write_text("# H")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {r["title"]: (r["media_type"], r["text"]) for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("text/plain", "café �"), "b": ("text/markdown", "# H"), "c": (None, None)}
    rows = [{"id": "1", "q": "x"}, {"id": "2", "q": None}]
    for name, body in (("x.json", json.dumps(rows)), ("y.json", "\n".join(map(json.dumps, rows))), ("z.json", json.dumps({"entries": rows}))):
        p = tmp_path / "j"
        p.mkdir(exist_ok=True)
        (p / name).write_text(body)
        assert sorted(map(tuple, S.read_records(spark, str(p / name), "id string, q string").collect())) == [("1", "x"), ("2", None)]
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/x </loc><lastmod>2024-03-01</lastmod></url><url><loc>https://a.example/y</loc></url></urlset>')
    assert sorted(map(tuple, S.read_sitemap(spark, str(tmp_path / "s.xml")).collect()), key=str) == [("https://a.example/x", 2024, 3), ("https://a.example/y", None, None)]


def test_communities_split_two_cliques(spark):
    e = [(f"{p}{i}", f"{p}{j}", 2.0) for p in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.5)]
    got = {r["entity_id"]: r["community"] for r in G.label_communities(spark.createDataFrame(e, "u string, v string, weight double")).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_levels_parents_and_inner_weight(spark):
    e = [(f"{p}{i}", f"{p}{j}", 2.0) for p in "abc" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 1.5), ("b1", "c1", 0.5)]
    e = spark.createDataFrame(e, "u string, v string, weight double")
    levels = G.community_levels(e)
    rows = {(r["level"], r["community"]): r for r in G.community_table(levels, e).collect()}
    zero = [r for (level, _), r in rows.items() if level == 0]
    assert sorted((r["n_members"], r["inner_weight"]) for r in zero) == [(4, 12.0)] * 3 and all((1, r["parent"]) in rows for r in zero)
    last = max(level for level, _ in rows)
    assert last == 2 and all(r["parent"] is None for (level, _), r in rows.items() if level == last)
    assert G.label_communities(e.limit(0)).count() == 0


def test_a_round_of_communities_is_few_jobs(spark, monkeypatch):
    rnd = random.Random(4)
    rows = {(min(a, b), max(a, b)): float(rnd.randint(1, 4)) for a, b in ((f"n{rnd.randint(0, 9)}", f"n{rnd.randint(0, 99)}") for _ in range(250)) if a != b}
    e = G.cut_table(spark.createDataFrame([(*k, w) for k, w in rows.items()], "u string, v string, weight double"))

    def run(name):
        spark.sparkContext.setJobGroup(name, name)
        got = {r["entity_id"]: r["community"] for r in G.label_communities(e).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, jobs

    rounds = []
    whole = G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or whole(df))
    got, jobs = run("communities")
    assert set(got) == {x for k in rows for x in k} and jobs <= 45 + 4 * len(rounds)
    monkeypatch.setattr(G, "HUB_ROWS", 0)  # every vertex of more than a thousandth of the edges hears by broadcast
    assert run("hubs")[0] == got


def test_cut_tables_are_cleared(spark):
    from pathlib import Path

    from weftline import session

    df = session.cut_table(spark.range(5))
    place = Path(session._TABLES[-1].removeprefix("file:"))
    assert df.count() == 5 and place.exists()
    assert session.clear_tables(spark) >= 1 and not place.exists() and session.clear_tables(spark) == 0


def test_hub_join_equals_a_join(spark):
    rnd = random.Random(2)
    big = spark.createDataFrame([(i, "hub" if rnd.random() < 0.4 else None if rnd.random() < 0.1 else f"k{rnd.randint(0, 30)}") for i in range(3000)], "i int, k string")
    small = spark.createDataFrame([("hub", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, hub_join(big, small, "k", how).select("i", "v").collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).select("i", "v").collect()), key=str)
    assert hub_join(big.limit(0), small, "k").count() == 0


def test_merged_rows(spark):
    cols = "record_id long, entity_id string, name string, description string, aliases array<string>, confidence double, source_chunk_ids array<string>"
    rows = [(2, "e", "B", "long text", ["x", None, " "], float("nan"), ["c2", "c1"]), (1, "e", "A", "short", ["y", "x"], 0.5, ["c1"]), (3, "e", "A", "also long", None, 2.0, None)]
    r = M.merged_entities(spark.createDataFrame(rows, cols), ["entity_id"]).first()
    assert (r["base"], r["description"], r["confidence"], r["aliases"], r["source_chunk_ids"], r["n_records"]) == ("A", "long text", 0.5, ["x", "y"], ["c1", "c2"], 3)
    assert M.merged_entities(spark.createDataFrame([], cols), ["entity_id"]).count() == 0


def test_mentions_by_name_alias_and_part(spark):
    q = spark.createDataFrame([(1, "Signal of the Sea"), (2, "who wrote signal of the sea, and when"), (3, "the sea"), (4, None), (5, "")], "qid int, query string")
    keys = spark.createDataFrame([("e", "signal of the sea", 0), ("f", "who", 1), ("g", "the sea", 1)], "entity_id string, key string, alias int")
    got = sorted((r["qid"], r["entity_id"], r["distance"]) for r in C.mentions(q, keys).collect())
    assert got == [(1, "e", 0.0), (1, "g", 0.15), (2, "e", 0.15), (2, "f", 0.15), (2, "g", 0.15), (3, "e", 0.05), (3, "g", 0.02)]


def test_json_out_of_prose_and_broken_text(spark):
    df = spark.createDataFrame([('see ```json\n[{"a": 1}]\n``` ok',), ('x {"a": 1} {"b": [2]} {"c": } [3]',), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(T.json_part(F.col("t"))).collect()] == ['[{"a": 1}]', '{"a": 1} {"b": [2]} {"c": }', None, None]
    assert [r[0] for r in df.select(F.size(T.json_objects(F.col("t")))).collect()][:2] == [1, 2]
    assert [r[0] for r in df.select(H.json_values("t")).collect()] == [['[{"a": 1}]'], ['{"a": 1}', '{"b": [2]}', "[3]"], None, []]


def test_noise_classes_and_clean_chunks(spark):
    names = ["", None, "x", "They", "every", "Songs", "10:30 am - 11:00", "12.5%", "3rd", "Rain Song"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.noise_class(F.col("n"))).collect()] == ["empty", "empty", "single_char", "pronoun", "article", "generic_term", "time_fragment", "pure_number", "ordinal", None]
    prose = "The fee follows the size of the room. Schools file a shorter form. Writers join when one work was performed in public."
    df = spark.createDataFrame([(prose, "https://a/x"), (prose, "https://a/search?q=1"), ("Read more " * 12 + "a. b.", None), ("short. text.", None)], "t string, u string")
    assert [r[0] for r in df.select(T.is_clean(F.col("t"), F.col("u"))).collect()] == [True, False, False, False]


def test_text_without_heading_is_one_section(spark):
    docs = spark.createDataFrame([(1, "# One\nx y"), (2, "no heading here"), (3, "")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["section_no"], r["anchor"]) for r in I.sections_or_whole(docs, "doc_id", "text").collect()) == [(1, 1, "one"), (2, 0, None), (3, 0, None)]


def test_streams_over_several_files_and_repeated_delivery(spark, tmp_path):
    ev = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 2, "view", 1.0, None) for i in range(24)]
    df = spark.createDataFrame(ev, "event_id long, t string, user_id long, event_type string, value double, props string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "f1"))
    df.filter("event_id < 3").coalesce(1).write.parquet(str(tmp_path / "in" / "f2"))
    out = P.windowed_counts(spark, P.stream_files(spark, str(tmp_path / "in" / "*"), P.EVENTS)).collect()
    assert sorted(r["n"] for r in out) == [8, 8, 8]
    mem = {r["user_id"]: (r["kept"], r["n_summarised"]) for r in P.session_memory(spark, P.stream_files(spark, str(tmp_path / "in" / "f1"), P.EVENTS)).collect()}
    assert set(mem) == {0, 1} and all(len(k.split(",")) == 5 and n == 7 for k, n in mem.values())


def test_replacing_stream_adds_nothing_twice(spark, tmp_path):
    rows = lambda v, n: spark.createDataFrame([("d", v, i) for i in range(n)], "doc_id string, doc_version string, chunk_index int")
    rows("1", 3).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    rows("1", 2).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = P.stream_files(spark, str(tmp_path / "in" / "*"), "doc_id string, doc_version string, chunk_index int", 1)
    P.replace_chunks(spark, stream, str(tmp_path / "out"))
    rows("1", 2).withColumn("doc_id", F.lit("other")).coalesce(1).write.parquet(str(tmp_path / "in" / "c"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"] for r in out.collect()} == {"d"} and out.count() in (2, 3)
    P.replace_chunks(spark, P.stream_files(spark, str(tmp_path / "in" / "c"), "doc_id string, doc_version string, chunk_index int"), str(tmp_path / "out"))
    P.replace_chunks(spark, P.stream_files(spark, str(tmp_path / "in" / "c"), "doc_id string, doc_version string, chunk_index int"), str(tmp_path / "out"))
    assert {r["doc_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").count().collect()}["other"] == 2


def test_entry_has_columns_and_names():
    import __spark_entry__ as E

    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
