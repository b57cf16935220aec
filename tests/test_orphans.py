from datetime import datetime as D

import pytest

from weftline.operators import orphans as O

REFS = "table_name string, field_name string, record_key string, ref string, families array<string>, created_at timestamp"
PARENTS = "family string, key string, created_at timestamp, deleted_at timestamp"


def run(spark, refs, parents):
    r = spark.createDataFrame([("t", "f", *x) for x in refs], REFS)
    p = spark.createDataFrame(parents, PARENTS)
    return sorted(map(tuple, O.find_orphans(r, p).select("record_key", "ref_key", "orphan_kind", "period").collect()), key=str)


def test_kinds_case_space_and_repeats(spark):
    old, new = D(2024, 1, 1), D(2024, 6, 1)
    parents = [("a", "d_chunk_0", old, None), ("a", "d_chunk_1", old, new), ("a", "d_chunk_3", new, None), ("a", "d_chunk_1", new, new), ("b", "anna", old, None), ("a", None, old, None)]
    refs = [("1", " D_chunk_0 ", ["a"], D(2024, 2, 1)), ("2", "d_chunk_1", ["a"], D(2024, 2, 1)), ("3", "d_chunk_2", ["a"], D(2024, 2, 1)), ("4", "d_chunk_3", ["a"], D(2024, 2, 1)), ("5", "d_chunk_3", ["a"], D(2024, 7, 1)),
            ("6", "ANNA", ["a", "b"], D(2024, 2, 1)), ("7", "ben", ["a", "b"], None), ("7", "ben", ["a", "b"], None), ("8", "  ", ["a"], old), ("9", None, ["a"], old), ("10", "d_chunk_00", ["a"], old), ("11", "d_chunk_3", ["a"], None)]
    assert run(spark, refs, parents) == sorted([("2", "d_chunk_1", "deleted", "2024-02"), ("3", "d_chunk_2", "missing", "2024-02"), ("4", "d_chunk_3", "late", "2024-02"), ("7", "ben", "missing", None), ("10", "d_chunk_00", "missing", "2024-01")], key=str)


def test_first_family_decides(spark):
    t = D(2024, 1, 1)
    assert run(spark, [("1", "x", ["a", "b"], t)], [("a", "x", t, t), ("b", "x", t, None)]) == [("1", "x", "deleted", "2024-01")]


def test_hot_key_and_empty_tables(spark):
    t = D(2024, 1, 1)
    refs = [(str(i), "gone", ["a"], t) for i in range(3000)] + [(f"x{i}", f"k{i}", ["a"], t) for i in range(50)]
    assert len(run(spark, refs, [("a", f"k{i}", t, None) for i in range(50)])) == 3000
    assert len(run(spark, refs[:5], [])) == 5
    assert run(spark, [], []) == []


@pytest.mark.parametrize("key", ["d_chunk_2047", "d_chunk_2048", "0123456789abcdef", "00000000-0000-0000-0000-00000000000f", "name"])
def test_runs_are_whole_across_blocks(spark, key):
    t = D(2024, 1, 1)
    parents = [("a", f"d_chunk_{i}", t, None) for i in range(3000)] + [("a", "0123456789abcdef", t, None), ("a", "00000000-0000-0000-0000-00000000000f", t, None), ("a", "name", t, None)]
    assert run(spark, [("1", key, ["a"], t)], parents) == []
    assert run(spark, [("1", "d_chunk_3000", ["a"], t)], parents) == [("1", "d_chunk_3000", "missing", "2024-01")]


def test_extra_columns_with_clashing_names(spark):
    from weftline.session import pick

    df = spark.createDataFrame([(1, "x", 2)], "record_id int, RECORD_ID string, other int")
    assert pick(df, "record_id", "other").collect()[0].asDict() == {"record_id": 1, "other": 2}
