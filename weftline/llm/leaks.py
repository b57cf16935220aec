"""Passages of evaluation items inside training texts.

Each task cuts its texts into shards of bounded size and builds an FM-index of each: a suffix array, the Burrows-
Wheeler transform in a wavelet matrix with popcount blocks, and every SAMPLE-th suffix position. The phrases of all
passages (every run of SEED letters or digits) are searched backward together, one letter at a time, through the
ranks of the wavelet matrix; what remains is located by stepping to the next sampled suffix. The hits of an item in
a text are chained in order, the longest chain decides, further ones show where the passage stands again, and the
hits merge into the spans to remove.

Letters are compared in lower case without accents, spaces, punctuation, markup or invisible characters, so that
another layout, hyphenation or typeface changes nothing. The texts are never shuffled; only the phrases travel."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.session import cut_table, pick, spread, table

#: Letters in a phrase; letters in a shard; sampling of suffix positions.
SEED, SHARD, SAMPLE = 14, 2_000_000, 4
#: A leak holds so much of the passage in order, and so much of it in phrases that no other passage has.
COVER, OWN = 0.28, 0.14
#: Letters of passages whose phrases a task holds at once; more items are searched block by block in the same index.
PASSAGES_AT_ONCE = 4_000_000
BASE = 38  # end of text, separator, 26 letters, 10 digits
# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмнтвгαεορτυχικνβ", "aeopcyxijsdhkmhtbraeoptuxikvb"))
_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")


def _symbol(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalnum():
        return 0
    for c in unicodedata.normalize("NFKD", ch).casefold():
        c = LOOKALIKES.get(c, c)
        if "a" <= c <= "z":
            return ord(c) - 96
        if "0" <= c <= "9":
            return ord(c) - 21
        if c.isalnum():
            return 1 + ord(c) % 36
    return 0


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol by code point: 0 for what does not count."""
    return np.fromiter((_symbol(cp) for cp in range(0x1F800)), np.uint8, 0x1F800)


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text and the place of each in it."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = symbols()[np.minimum(cps, 0x1F7FF)]
    if "<" in text or "&" in text:
        codes = codes.copy()
        for m in _MARKUP.finditer(text):
            codes[m.start() : m.end()] = 0
    at = np.flatnonzero(codes)
    return codes[at], at


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    padded = np.zeros(n + 12, np.int64)
    padded[:n] = s.astype(np.int64) + 1
    key = padded[:n].copy()
    for j in range(1, 12):
        key *= BASE
        key += padded[j : n + j]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, places, 0))
    h = 12
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not tied.size:
            return sa
        pos = sa[tied]
        after = pos + h
        key = rank[pos] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        sa[tied] = pos
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        new[tied] = first
        rank[pos] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        h *= 2


class FMIndex:
    """Backward search and location for many patterns at once."""

    LEVELS = 6

    def __init__(self, s: np.ndarray) -> None:
        self.n = n = len(s)
        sa = suffix_array(s)
        self.bwt = bwt = s[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=64))]).astype(np.int64)
        self.words, self.blocks, self.zeros = [], [], []
        level = bwt
        for b in range(self.LEVELS - 1, -1, -1):
            bits = (level >> b & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(n - int(self.blocks[-1][-1]))
            one = bits.astype(bool)
            level = np.concatenate([level[~one], level[one]])
        held = sa % SAMPLE == 0
        packed = np.packbits(np.concatenate([held, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.held, self.held_words = held, packed
        self.held_blocks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
        self.samples = sa[held].astype(np.int64)

    @staticmethod
    def _ones(words: np.ndarray, blocks: np.ndarray, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return blocks[i >> 6] + np.bitwise_count(words[i >> 6] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i of the transform."""
        lo = np.zeros_like(i)
        for level in range(self.LEVELS):
            one = (c >> (self.LEVELS - 1 - level) & 1).astype(bool)
            words, blocks, zeros = self.words[level], self.blocks[level], self.zeros[level]
            a, b = self._ones(words, blocks, lo), self._ones(words, blocks, i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """patterns: one a row. The rows that occur, with their ranges of suffixes."""
        rows = np.arange(len(patterns))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[rows, j].astype(np.int64)
            lo, hi = self.start[c] + self.rank(c, lo), self.start[c] + self.rank(c, hi)
            there = lo < hi
            rows, lo, hi = rows[there], lo[there], hi[there]
        return rows, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes i: steps back in the text until a sampled suffix is met."""
        out, todo, at, steps = np.empty(len(i), np.int64), np.arange(len(i)), i.copy(), 0
        while todo.size:
            done = self.held[at]
            out[todo[done]] = self.samples[self._ones(self.held_words, self.held_blocks, at[done])] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt[at].astype(np.int64)
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The phrases of a block of passages: letters, item and offset of each; whether it is the item's own. items: id,
    passage and the offsets of the phrases that are not its own (see shared_phrases; none if left out)."""

    def __init__(self, items: list[tuple]) -> None:
        rows, item, offset, own, self.ids, self.size = [], [], [], [], [], []
        for item_id, passage, *shared in items:
            s, _ = letters(passage or "")
            if len(s) < SEED:
                continue
            rows.append(np.lib.stride_tricks.sliding_window_view(s, SEED))
            offset.append(np.arange(len(rows[-1])))
            item.append(np.full(len(rows[-1]), len(self.ids)))
            own.append(np.ones(len(rows[-1]), bool))
            own[-1][np.array(shared[0] if shared else [], np.int64)] = False
            self.ids.append(item_id)
            self.size.append(len(s))
        empty = np.zeros(0, np.int64)
        rows = np.concatenate(rows) if rows else np.zeros((0, SEED), np.uint8)
        item, offset = (np.concatenate(x) if x else empty for x in (item, offset))
        self.patterns, self.of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, empty)
        self.of = self.of.reshape(-1)
        order = np.argsort(self.of, kind="stable")
        self.item, self.offset, self.own = item[order], offset[order], (np.concatenate(own) if own else np.zeros(0, bool))[order]
        self.first = np.searchsorted(self.of[order], np.arange(len(self.patterns) + 1))


def covered(o: np.ndarray) -> int:
    """Letters covered by phrases at these offsets, which rise."""
    return int(np.minimum(np.diff(o, append=o[-1] + SEED), SEED).sum()) if len(o) else 0


def chain(places: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Longest run of hits in order of both; the letters it covers, those it covers by own phrases, its places."""
    order = np.lexsort((-offsets, places))
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(order), -1)
    for k, i in enumerate(order):
        o = int(offsets[i])
        j = bisect.bisect_left(tails, o)
        if j == len(tails):
            tails.append(o)
            ends.append(k)
        else:
            tails[j], ends[j] = o, k
        before[k] = ends[j - 1] if j else -1
    path, k = [], ends[-1] if ends else -1
    while k >= 0:
        path.append(order[k])
        k = before[k]
    path = np.array(path[::-1])
    o = offsets[path]
    return covered(o), covered(o[own[path]]), places[path]


def chains(places: np.ndarray, offsets: np.ndarray, own: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """The longest chain, then those that its hits leave over, while they cover `least` letters."""
    while covered(np.unique(offsets)) >= least:
        cover, alone, path = chain(places, offsets, own)
        yield cover, alone, path
        after = np.searchsorted(path, places)  # hits that share letters with a hit of the chain are done
        near = np.minimum(np.abs(places - path[np.maximum(after - 1, 0)]), np.abs(path[np.minimum(after, len(path) - 1)] - places))
        left = near >= SEED
        places, offsets, own = places[left], offsets[left], own[left]


def shard_index(docs: list[tuple[object, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, FMIndex]:
    """Where each text begins, and the index of all of them."""
    begins = np.cumsum([0] + [len(d[1]) + 1 for d in docs])
    s = np.zeros(begins[-1], np.uint8)
    for b, d in zip(begins, docs):
        s[b : b + len(d[1])] = d[1]
    return begins, FMIndex(s)


def shard_hits(docs: list[tuple[object, np.ndarray, np.ndarray, int]], phrases: Phrases, indexed: tuple[np.ndarray, FMIndex] | None = None) -> list[tuple]:
    """docs: key, symbols, places, number of the piece. One row a text and item: key, item_id, cover and own of the
    longest chain, spans of all chains that count."""
    begins, index = indexed or shard_index(docs)
    rows, lo, hi = index.search(phrases.patterns)
    if not len(rows):
        return []
    many = hi - lo
    suffixes = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    place, pattern = index.locate(suffixes), np.repeat(rows, many)
    uses = phrases.first[pattern + 1] - phrases.first[pattern]
    use = np.repeat(phrases.first[pattern] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum())
    place = np.repeat(place, uses)
    item, offset, own = phrases.item[use], phrases.offset[use], phrases.own[use]
    doc = np.searchsorted(begins, place, side="right") - 1
    pair = doc * len(phrases.ids) + item
    order = np.argsort(pair, kind="stable")
    pair, place, offset, own, doc, item = pair[order], place[order], offset[order], own[order], doc[order], item[order]
    edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
    size = np.array(phrases.size)
    out = []
    for a, b in zip(edges, edges[1:]):
        i, d = int(item[a]), int(doc[a])
        if (b - a) * SEED / size[i] < COVER:
            continue  # all hits together cover less than counts
        longest, spans = None, []
        for cover, alone, path in chains(place[a:b], offset[a:b], own[a:b], COVER * size[i]):
            longest = longest or (cover / size[i], alone / size[i])
            if cover / size[i] < COVER or alone / size[i] < OWN:
                continue
            at = docs[d][2][path - begins[d]].tolist()
            ends = (docs[d][2][path - begins[d] + SEED - 1] + 1).tolist()
            spans.append([at[0], ends[0]])
            for x, y in zip(at, ends):
                if x <= spans[-1][1] + 40:
                    spans[-1][1] = max(spans[-1][1], y)
                else:
                    spans.append([x, y])
        if longest:
            out.append((docs[d][0], phrases.ids[i], *longest, [{"begin": x, "end": y} for x, y in sorted(spans)]))
    return out


@pandas_udf(T.StringType())
def letter_text(passages: pd.Series) -> pd.Series:
    return passages.map(lambda p: (letters(p)[0] + 47).tobytes().decode("ascii"))


def shared_phrases(items: DataFrame) -> DataFrame:
    """item_id, passage, shared: the offsets of the phrases that an unrelated passage has too, counted over all items.
    Equal passages are one; a passage is related to those that it holds and to those that hold it."""
    said = items.withColumn("said", letter_text("passage")).withColumn("kind", F.md5(F.col("said").cast("binary")))
    kinds = said.filter(F.length("said") >= SEED).select("kind", "said").distinct()
    uses = kinds.select("kind", F.explode(F.transform(F.sequence(F.lit(0), F.length("said") - SEED), lambda o: F.struct(o.alias("offset"), F.substring("said", o + 1, F.lit(SEED)).alias("phrase")))).alias("x")).select("kind", "x.*")
    once = uses.select("kind", "phrase").distinct()
    counted = once.join(once.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")), "phrase")
    # what holds a passage has its rarest phrase too
    rarest = counted.groupBy("kind").agg(F.min(F.struct("n", "phrase")).alias("r")).filter("r.n > 1").select(F.col("kind").alias("inner"), "r.phrase")
    side = lambda n: kinds.select(F.col("kind").alias(n), F.col("said").alias(f"said_{n}"))
    near = rarest.join(once.withColumnRenamed("kind", "outer"), "phrase").filter(F.col("inner") != F.col("outer")).select("inner", "outer")
    inside = near.join(side("inner"), "inner").join(side("outer"), "outer").filter(F.col("said_outer").contains(F.col("said_inner"))).select("inner", "outer")
    holders = inside.groupBy(F.col("inner").alias("kind")).agg(F.count(F.lit(1)).alias("n_out"))
    held = inside.join(once.withColumnRenamed("kind", "inner"), "inner").groupBy(F.col("outer").alias("kind"), "phrase").agg(F.count(F.lit(1)).alias("n_in"))
    related = F.lit(1) + F.coalesce("n_out", F.lit(0)) + F.coalesce("n_in", F.lit(0))
    foreign = counted.filter("n > 1").join(holders, "kind", "left").join(held, ["kind", "phrase"], "left").filter(F.col("n") > related).select("kind", "phrase")
    shared = uses.join(foreign, ["kind", "phrase"], "left_semi").groupBy("kind").agg(F.collect_list("offset").alias("shared"))
    return said.join(shared, "kind", "left").select("item_id", "passage", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


@lru_cache(1)
def phrases_of(block: tuple) -> Phrases:
    return Phrases(list(block))


def passage_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, item_id, cover and own (shares of the passage), spans (begin, end in characters of the text).

    items: item_id, passage; the passages go to every task in blocks of PASSAGES_AT_ONCE letters, collected one block
    at a time, and a task makes the phrases of one block at a time. The corpus is read and indexed once.
    Null, empty and short texts and passages have no hits (see short_items). A longer text than a shard is read in pieces that
    overlap by more than two passages, so no part of it is left out."""
    spark = docs.sparkSession
    items = pick(items, "item_id", "passage").filter("passage is not null").distinct()
    n_letters, longest = items.agg(F.sum(F.length("passage")), F.max(F.length("passage"))).first()
    blocks = max(1, -(-int(n_letters or 0) // PASSAGES_AT_ONCE))
    items = cut_table(shared_phrases(items).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    docs = spread(pick(docs, id_col, text_col).filter(F.col(text_col).isNotNull()))
    overlap = 3 * int(longest or 0)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, cover double, own double, spans array<struct<begin:int,end:int>>"
    shared = [spark.sparkContext.broadcast(tuple((r["item_id"], r["passage"], tuple(r["shared"])) for r in items.filter(F.col("block") == k).collect())) for k in range(blocks)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n = 0

        def flush() -> pd.DataFrame:
            indexed = shard_index(held)
            return pd.DataFrame([h for b in shared for h in shard_hits(held, phrases_of(b.value), indexed)], columns=[id_col, "item_id", "cover", "own", "spans"])

        for batch in batches:
            for key, text in zip(batch[id_col], batch[text_col]):
                s, at = letters(text)
                for begin in range(0, max(1, len(s)), SHARD):
                    piece = slice(max(0, begin - overlap), begin + SHARD)
                    if len(s[piece]) < SEED:
                        continue
                    held.append((key, s[piece], at[piece], begin))
                    n += len(s[piece])
                    if n >= SHARD:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    return docs.mapInPandas(run, schema)


def merge_spans(spans: Column) -> Column:
    """Spans in order, those that overlap or touch put together; an empty array for none."""
    grow = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["begin"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<begin:int,end:int>>"), grow)


def letters_in(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x["end"] - x["begin"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cover, own, spans of texts that hold a passage, wholly or in part; one row a pair, the spans of
    every place where it stands, merged over the pieces of a text."""
    hits = passage_hits(docs, items).filter((F.col("cover") >= COVER) & (F.col("own") >= OWN))
    return hits.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"), F.max("own").alias("own"), merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))


def removal_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, spans: what to remove from each text, merged over all items."""
    return leaks(docs, items).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))


def short_items(items: DataFrame) -> DataFrame:
    """item_id, short: whether the passage is null or below SEED letters, that is within a phrase that never counts."""
    said = pick(items, "item_id", "passage").select("item_id", F.length(letter_text(F.coalesce("passage", F.lit("")))).alias("n"))
    return said.groupBy("item_id").agg((F.max("n") < SEED).alias("short"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of texts that hold it and of characters to remove, and whether it is too short to be
    searched."""
    items = table(spark, sf_dir, "eval_items")
    rows = leaks(table(spark, sf_dir, "documents"), items).select("item_id", letters_in(F.col("spans")).alias("n")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))
    return short_items(items).join(rows, "item_id", "left").select("item_id", "short", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def p7_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_items, n_chars: characters to remove from each text, counted once where items overlap."""
    return removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "n_items", letters_in(F.col("spans")).alias("n_chars"))


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_removal": p7_removal}
