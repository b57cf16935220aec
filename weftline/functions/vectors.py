"""Vector expressions and exact top-k search of a stated query set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null or zero vector or unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def finite(v: Column, dim: int) -> Column:
    """dim finite values that are not all 0 (NaN is greater than infinity here)."""
    top, low = F.array_max(v), F.array_min(v)
    return v.isNotNull() & (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (top < float("inf")) & (low > float("-inf")) & ~((top == 0) & (low == 0))


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best k of each row; equal ones by place."""
    n = score.shape[1]
    if n > k:
        edge = np.partition(score, n - k, axis=1)[:, n - k][:, None]
        m = int((score >= edge).sum(axis=1).max())
        at = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(np.arange(n), score.shape)
    else:
        at = np.broadcast_to(np.arange(n), score.shape)
    some = np.take_along_axis(score, at, axis=1)
    order = np.lexsort((at, -some), axis=1)[:, :k]
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(some, order, axis=1)


#: Queries in a block; rows that a block meets at once.
QUERY_BLOCK, ROW_BLOCK = 2048, 20_000


def in_blocks(queries: DataFrame, rows: DataFrame, qid: str, rid: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns _block and _bucket, so that every block of queries meets every bucket of rows in one
    group of bounded size. Only the two counts reach the driver. Rows travel once for each block of queries, queries once
    for each bucket of rows; no pair is stored."""
    blocks, buckets = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-rows.count() // ROW_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_block", F.pmod(F.xxhash64(qid), F.lit(blocks)).cast("int")).withColumn("_bucket", each(buckets))
    r = rows.withColumn("_bucket", F.pmod(F.xxhash64(rid), F.lit(buckets)).cast("int")).withColumn("_block", each(blocks))
    return q, r


def found_frame(qid, rid, score, name: str) -> pd.DataFrame:
    """Ids as plain objects: string columns of pandas may come in several chunks, which Arrow structs refuse."""
    return pd.DataFrame({"qid": pd.Series(qid, dtype=object), "id": pd.Series(rid, dtype=object), name: pd.Series(score, dtype="float64")})


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, other: bool = False) -> DataFrame:
    """qid, id, sim, rank: exact cosine top-k of every query by (sim rounded to 6 places, id); with `other` without the
    row whose id is the query's. queries: qid, vec; rows: id, vec, all usable. Blocks of queries and buckets of rows meet in
    groups; each keeps its own best k, which a window merges."""

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return found_frame([], [], [], "sim")
        r = r.sort_values("id", ignore_index=True)
        unit = lambda c: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.stack(c.to_numpy()).astype(np.float64))
        x, ids, out = unit(r["vec"]), r["id"].to_numpy(), []
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256]
            sim = np.round(unit(part["vec"]) @ x.T, 6)
            if other:
                sim[part["qid"].to_numpy()[:, None] == ids[None, :]] = -9
            at, best = best_columns(sim, k)
            out.append((np.repeat(part["qid"].to_numpy(), at.shape[1]), ids[at.ravel()], best.ravel()))
        return found_frame(*map(np.concatenate, zip(*out)), "sim")

    q, r = in_blocks(queries.select("qid", "vec"), rows.select("id", "vec"), "qid", "id")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, sim double"
    found = q.groupBy("_block", "_bucket").cogroup(r.groupBy("_block", "_bucket")).applyInPandas(search, schema)
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    return found.filter("sim >= -1.5").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
