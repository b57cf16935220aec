from datetime import datetime as D

import pytest

from weftline.llm import survivorship as S

COLS = "record_id long, entity_id string, name string, canonical_key string, description string, aliases array<string>, confidence double, source_chunk_ids array<string>, extractor string, updated_at timestamp, deleted_at timestamp"


def rec(i, e="e", name="Ann Bo", key="ann bo", text=None, al=None, conf=None, ids=None, ex="llm", at=D(2024, 1, 1), gone=None):
    return (i, e, name, key, text, al, conf, ids, ex, at, gone)


def df(spark, rows):
    return spark.createDataFrame(rows, COLS)


@pytest.mark.parametrize(
    "text,n",
    [
        (None, 0), ("", 0), ("n/a", 0), ("TBD", 0), ("Writes folk pieces.", 1), ("Writes folk pieces. Writes folk pieces.", 1), ("Writes folk pieces. Toured Xy for", 1),
        ("Writes folk pieces. Toured Xy...", 1), ("Writes folk pieces. Toured Xy....", 2), ("Lyricist of Rain No. 15. Born in Xy.", 2), ("All rights reserved. Born in Xy.", 1),
        ('<div class="d">&nbsp;&nbsp;Born in Xy.</div><br/>', 1), ("Born in Xy. BORN IN XY.", 1), ("A. " * 20000 + "Born in Xy.", 2),
    ],
)
def test_facts(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(S.F.size(S.facts("t"))).first()[0] == n


def test_survivors_ties_nulls_and_repeats(spark):
    rows = [rec(1, text="One fact.", conf=0.9), rec(2, text="One fact. Two facts.", conf=float("nan"), at=D(2024, 2, 1)), rec(3, text="One fact. Two facts.", conf=0.9, at=D(2024, 3, 1)), rec(4, text=None, conf=1.5, gone=D(2024, 1, 1)),
            rec(5, e="one"), rec(5, e="one"), rec(6, e=None), rec(7, e=None), rec(8, e="none", conf=-1.0), rec(9, e="none", conf=None, at=D(2024, 5, 1))]
    got = {r["entity_id"]: r for r in S.survivors(df(spark, rows)).collect()}
    assert set(got) == {"e", "none"}
    assert (got["e"]["description_record"], got["e"]["confidence_record"]) == (3, 3)
    assert (got["none"]["description_record"], got["none"]["confidence_record"]) == (9, None)


def test_items(spark):
    rows = [rec(1, al=[" Ann  Bo ", "ANN BO", "A. Bo ", None, "", "N/A"], ids=[" c1 ", "", None, "c1"]), rec(2, al=None, ids=["c2"]), rec(3, e="single", al=["x y"], ids=["c"])]
    got = sorted(tuple(r) for r in S.surviving_items(df(spark, rows)).collect())
    assert got == [("e", "aliases", "a. bo"), ("e", "aliases", "ann  bo"), ("e", "source_chunk_ids", "c1"), ("e", "source_chunk_ids", "c2")]


def rules(spark, rows):
    return {(r["a"], r["b"]) for r in S.learn_precedence(df(spark, rows).withColumn("marks", S.F.array(*S.currency_values()))).filter("attr='extractor'").collect()}


def seen(start, *extractors):
    return [rec(1000 * start + i, e=f"t{start}", ex=x, at=D(2024, 1, 1 + i)) for i, x in enumerate(extractors)]


def test_chains_close_and_cycles_break_at_the_weakest_vote(spark):
    assert rules(spark, seen(1, "a", "b") + seen(2, "b", "c")) == {("a", "b"), ("b", "c"), ("a", "c")}  # a and c never meet
    cycle = seen(1, "a", "b") + seen(2, "a", "b") + seen(3, "b", "c") + seen(4, "b", "c") + seen(5, "c", "a")
    assert rules(spark, cycle) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert rules(spark, seen(1, "a", "b") + seen(2, "b", "a")) == set() and rules(spark, []) == set()


def test_partial_order_within_a_group(spark):
    teach = seen(11, "a", "b", "c") + seen(12, "a", "b", "c")
    group = [rec(1, ex="a", text="X y.", at=D(2024, 6, 1)), rec(2, ex="c", text="X y.", at=D(2024, 9, 1)), rec(3, ex="b", text="X y.", at=None), rec(4, ex="unseen", text="X y.", at=None), rec(5, ex="c", text="X y.", at=None)]
    rows = {r["record_id"]: (r["as_of"], r["level"]) for r in S.with_currency(df(spark, teach + group)).filter("entity_id = 'e'").collect()}
    assert rows == {1: (D(2024, 6, 1), 0), 2: (D(2024, 9, 1), 0), 3: (D(2024, 6, 1), 1), 4: (None, 0), 5: (D(2024, 9, 1), 2)}
    # dates against the rules: c is older than a, so b can only follow what precedes c
    turned = [rec(1, ex="a", at=D(2024, 6, 1)), rec(2, ex="c", at=D(2024, 2, 1)), rec(3, ex="b", at=None)]
    rows = {r["record_id"]: r["as_of"] for r in S.with_currency(df(spark, teach + turned)).filter("entity_id = 'e'").collect()}
    assert rows[3] is None


def test_order_does_not_depend_on_whether_any_date_is_missing(spark):
    group = [rec(i, text="X y.", conf=0.5, at=D(2024, 1, 1 + i)) for i in range(8)]
    other = rec(99, e="z", at=None)
    one = lambda rows: {r["entity_id"]: (r["description_record"], r["confidence_record"]) for r in S.surviving_records(df(spark, rows)).collect()}
    assert one(group)["e"] == one([*group, other])["e"] == (7, 7)


def test_undated_records_are_placed_by_learned_rules(spark):
    teach = [r for i in range(0, 40, 2) for r in (rec(100 + i, e=f"t{i}", ex="llm"), rec(101 + i, e=f"t{i}", ex="gleaning", at=D(2024, 1, 5)))]
    group = [rec(1, ex="llm", text="A fact.", at=D(2024, 6, 1)), rec(2, ex="gleaning", text="A fact.", at=None), rec(3, ex="llm", text="A fact.", at=D(2024, 5, 1))]
    assert rules(spark, teach) == {("llm", "gleaning")}
    got = {r["entity_id"]: r["description_record"] for r in S.survivors(df(spark, teach + group)).collect()}
    assert got["e"] == 2
    assert S.survivors(df(spark, [rec(1, at=None), rec(2, at=None)])).count() == 1


def test_empty_and_clashing_columns(spark):
    assert S.survivors(df(spark, [])).count() == 0 and S.surviving_items(df(spark, [])).count() == 0
    more = df(spark, [rec(1), rec(2)]).withColumn("item", S.F.lit(1)).withColumn("level", S.F.lit(2)).withColumn("marks", S.F.lit(3))
    assert S.survivors(more).count() == 1
