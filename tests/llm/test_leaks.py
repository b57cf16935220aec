import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import leaks as L

PASSAGE = "When Hagairtzeluk reached 333 jukeboxes, Grileijur juggled them in the humid islet and Kalilnayak unsealed 894 notaries. Because Gegrundlepes was idle, its organist ransomed 629 ballots for Preigrektobot."
OTHER = "After Skazulmaben fell silent, the hamlet quoted by Draidokmin held 331 keen pamphlets. No innkeeper from Baigesuwat could index the dulcimer unless Retikijil unsealed 259 dusky copies."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300))
def test_suffix_array(s):
    s = np.array(s, np.uint8)
    assert L.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_search_and_locate_against_brute_force():
    rnd = random.Random(5)
    s = np.array([rnd.randint(1, 4) for _ in range(3000)] + [0], np.uint8)
    index = L.FMIndex(s)
    patterns = np.array([[rnd.randint(1, 4) for _ in range(5)] for _ in range(300)], np.uint8)
    rows, lo, hi = index.search(patterns)
    got = {r: sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows.tolist(), lo, hi)}
    want = {r: at for r in range(300) if (at := [i for i in range(len(s) - 4) if s[i : i + 5].tolist() == patterns[r].tolist()])}
    assert got == want


def found(spark, texts, items=((1, PASSAGE), (2, OTHER))):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in L.leaks(docs, spark.createDataFrame(list(items), "item_id long, passage string")).collect())


def test_changed_layouts_and_parts(spark):
    words = PASSAGE.split()
    texts = [
        "before " + PASSAGE + " after", PASSAGE.upper(), " ".join(w[:3] + "⁠" + w[3:] for w in words), "\n| ".join(words), PASSAGE.replace("juggled", "jug-\ngled").replace("unsealed", "un-\nsealed"), " ".join(words[:12]), PASSAGE.replace("a", "а").replace("e", "é"),
        "<p>" + "</p><p>".join([" ".join(words[:9]), " ".join(words[9:])]) + "</p>", " ".join(w if i % 9 else w[::-1] for i, w in enumerate(words)), PASSAGE + " " + OTHER, PASSAGE, PASSAGE,
    ]
    assert found(spark, texts) == sorted([(i, 1) for i in range(12)] + [(9, 2)])


def test_names_templates_and_empty_texts_do_not_count(spark):
    texts = [None, "", " ", "Hagairtzeluk and Kalilnayak appear in the registry.", "in the humid islet and", "After Xu fell silent, the hamlet quoted by Yo held 12 keen pamphlets.", "No innkeeper from Zu could index the dulcimer unless Wa sold 3 copies"]
    assert found(spark, texts) == []
    assert found(spark, [PASSAGE], [(1, None), (2, ""), (3, "short")]) == []
    assert found(spark, []) == []


def test_very_long_text_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 5000)
    docs = [(1, L.letters("lorem ipsum dolor " * 400 + PASSAGE + " sit amet " * 400))]
    phrases = L.Phrases([(7, PASSAGE)])
    hits = []
    for key, (s, at) in docs:
        for begin in range(0, len(s), 5000):
            piece = slice(max(0, begin - 3 * len(PASSAGE)), begin + 5000)
            hits += L.shard_hits([(key, s[piece], at[piece], begin)], phrases)
    assert {(h[0], h[1]) for h in hits if h[2] > 0.9} == {(1, 7)}


def test_spans_cover_the_passage(spark):
    text = "x y z. " + PASSAGE + " the end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = L.leaks(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, passage string")).first()
    assert [(s["begin"], s["end"]) for s in r["spans"]] == [(7, 7 + len(PASSAGE) - 1)]
    assert r["cover"] == pytest.approx(1.0)


def test_scattered_changes_are_judged_by_letters_not_by_hits(spark):
    whole = " ".join([PASSAGE, OTHER, PASSAGE[::-1]])
    for every, share in ((16, 0.7), (18, 0.5), (20, 0.4)):
        k, out = 0, []
        for ch in whole[: int(len(whole) * share)]:
            k += ch.isalnum()
            out.append("0" if ch.isalnum() and k % every == 0 else ch)
        assert found(spark, ["".join(out)], [(1, whole)]) == [(0, 1)]


def test_equal_and_contained_passages_do_not_hide_each_other(spark):
    part = " ".join(PASSAGE.split()[:14])
    assert found(spark, [PASSAGE, OTHER], [(1, PASSAGE), (2, PASSAGE.upper()), (3, part), (4, OTHER)]) == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_own_phrases_do_not_depend_on_blocks(spark, monkeypatch):
    frame = "Read the following passage with care and choose the right answer from the list below it. "
    items = [(i, frame + w) for i, w in enumerate(["Hagairtzeluk reached jukeboxes.", "Grileijur juggled the islets.", "Kalilnayak unsealed notaries.", "Preigrektobot ransomed ballots."])]
    texts = [frame + "Nothing else.", items[2][1]]
    assert found(spark, texts, items) == [(1, 2)]
    monkeypatch.setattr(L, "PASSAGES_AT_ONCE", 60)
    assert found(spark, texts, items) == [(1, 2)]


def test_a_passage_that_stands_twice_is_removed_twice(spark):
    text = f"{PASSAGE} and in between much else was said about nothing. {PASSAGE}"
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, "tiny")], "item_id long, passage string")
    rows = {r["item_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in L.leaks(docs, items).collect()}
    n = len(PASSAGE) - 1  # without the full stop
    assert rows == {i: [(0, n), (len(text) - n - 1, len(text) - 1)] for i in (1, 2)}
    r = L.removal_spans(docs, items).first()
    assert r["n_items"] == 2 and sum(s["end"] - s["begin"] for s in r["spans"]) == 2 * n
    assert {r["item_id"]: r["short"] for r in L.short_items(items).collect()} == {1: False, 2: False, 3: True}


def test_blocks_share_one_index(spark, monkeypatch):
    monkeypatch.setattr(L, "PASSAGES_AT_ONCE", 60)
    assert found(spark, [PASSAGE, OTHER, None], [(1, PASSAGE), (2, OTHER), (3, None)]) == [(0, 1), (1, 2)]
