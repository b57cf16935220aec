"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split into pieces by the vocabulary's pattern. In each piece a segment tree over the byte positions holds
the rank of the pair that starts at each live position; its root gives the leftmost pair of lowest rank. A merge
changes three leaves (the pair itself, its left neighbour and the position that dies), each in logarithmic time, so
a piece of n bytes takes n log n whatever its length. Pieces repeat, so tasks keep the codes of short ones."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from weftline.session import pick, spread, table

#: Where the vocabulary files lie; any path can be given instead.
VOCABULARIES = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30
#: Pieces kept by a worker, and the longest of them in characters: 64 bytes x 300,000 at most.
KEPT, KEPT_CHARS = 300_000, 32


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte: printable bytes stand for themselves, the
    others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and ids of pairs. Plain data, so that it can be broadcast: its size is that of the vocabulary file."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.of_byte = [0] * 256
        for letter, b in byte_letters().items():
            self.of_byte[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = i
            self.merged.append(vocab[a + b])
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = [self.of_byte[b] for b in piece]
        if n < 2:
            return ids
        rank, merged = self.rank, self.merged
        half = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * half)
        for i in range(n - 1):
            tree[half + i] = rank.get(ids[i] << 20 | ids[i + 1], NONE)
        for k in range(half - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = half + i
            tree[k] = value
            k >>= 1
            while k:
                left, right = tree[2 * k], tree[2 * k + 1]
                low = left if left <= right else right
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (best := tree[1]) != NONE:
            k = 1
            while k < half:  # the left child first: the leftmost of equal ranks
                k = 2 * k if tree[2 * k] == best else 2 * k + 1
            i = k - half
            j = after[i]
            ids[i] = merged[best]
            after[i] = m = after[j]
            ids[j] = -1
            put(j, NONE)
            put(i, rank.get(ids[i] << 20 | ids[m], NONE) if m < n else NONE)
            if m < n:
                before[m] = i
            if (p := before[i]) >= 0:
                put(p, rank.get(ids[p] << 20 | ids[i], NONE))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.split, self.kept = vocabulary, regex.compile(PATTERN), {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the strings of special tokens are ordinary text. Null and empty give []."""
        out: list[int] = []
        if not text:
            return out
        kept, encode = self.kept, self.vocabulary.encode_piece
        for piece in self.split.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = encode(piece.encode("utf-8", "replace"))
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and `ids` (array<int>), one row per row. Null and empty texts have an empty list. No shuffle."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or f"{VOCABULARIES}/byte_bpe_50k.json"))
    docs = spread(pick(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            ids, ends = [], [0]
            for text in batch.column(1).to_pylist():
                ids += encoder.encode(text)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    return docs.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids."""
    return encode_texts(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p6_ids": p6_ids}
