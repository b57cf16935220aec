"""Streams over landed files: windowed counts, idempotent replacement of chunks, session memory.

Every stream runs with the available-now trigger, so that it ends when what has landed is done; state and progress
lie in the shared checkpoint folder and survive a lost executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut_table, ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _place(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_files(spark: SparkSession, path: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def run_to_end(stream: DataFrame, mode: str, write, place: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(spark: SparkSession, events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total. Late events up to `late` still count; an event that is delivered twice counts once."""
    place = _place(spark, "windows")
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    run_to_end(counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "complete", lambda df, i: df.write.mode("overwrite").parquet(f"{place}/out"), place)
    return spark.read.schema("start timestamp_ntz, event_type string, n bigint, total double").parquet(f"{place}/out")


#: Memory of a session reaches back so many microseconds from its last event.
MEMORY = 30 * 24 * 3600 * 1_000_000
BUFFER_STATE = "n bigint, ids array<bigint>, at array<bigint>"


def _buffer(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, ids, at = state.get if state.exists else (0, [], [])
    kept = list(zip(list(at), list(ids)))
    for b in batches:
        n += len(b)
        kept += list(zip(b["micros"].tolist(), b["event_id"].tolist()))
    kept = sorted(kept)[-10:]
    kept = [x for x in kept if x[0] >= kept[-1][0] - MEMORY]
    state.update((int(n), [int(i) for _, i in kept], [int(t) for t, _ in kept]))
    shown = kept if n <= 10 else kept[-5:]
    yield pd.DataFrame({"user_id": [key[0]], "kept": [",".join(str(i) for i in sorted(i for _, i in shown))], "n_summarised": [max(0, n - 5) if n > 10 else 0]})


def session_memory(spark: SparkSession, events: DataFrame) -> DataFrame:
    """user_id, kept, n_summarised: the buffer of each user after the last event (ten at most, five once there were
    more), none older than MEMORY before the last one. The state of a user is ten ids, however many events there are."""
    place = _place(spark, "memory")
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    memory = rows.groupBy("user_id").applyInPandasWithState(_buffer, "user_id bigint, kept string, n_summarised bigint", BUFFER_STATE, "update", "NoTimeout")
    run_to_end(memory, "update", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{place}/out"), place)
    every = spark.read.schema("user_id bigint, kept string, n_summarised bigint, batch bigint").parquet(f"{place}/out")
    return every.groupBy("user_id").agg(F.max_by(F.struct("kept", "n_summarised"), "batch").alias("last")).select("user_id", "last.*")


#: Parts of the table of chunks, by the hash of the document.
PARTS = 16


def replace_chunks(spark: SparkSession, chunks: DataFrame, target: str) -> None:
    """Chunks (doc_id, doc_version, ...) replace those of the same document and version in a table partitioned by the hash
    of the document. A batch reads and rewrites only the parts that it touches; delivered again it writes the same rows again."""

    def write(df: DataFrame, i: int) -> None:
        df = df.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
        try:
            old = spark.read.schema(df.schema).parquet(target)
            touched = old.join(F.broadcast(df.select("part").distinct()), "part", "left_semi")
            df = touched.join(df.select("doc_id", "doc_version").distinct(), ["doc_id", "doc_version"], "left_anti").select(df.columns).unionByName(df)
        except AnalysisException:  # the first batch: there is no table yet
            pass
        cut_table(df).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)

    run_to_end(chunks, "append", write, _place(spark, "replace"))


def stm01_windowed_stream(spark, sf_dir):
    return windowed_counts(spark, stream_files(spark, f"{sf_dir}/event[s].parquet", EVENTS))


def stm02_replaced_chunks(spark, sf_dir):
    """The landed chunks after their stream was written: chunks of each document and version."""
    place = _place(spark, "chunks")
    landed = stream_files(spark, f"{sf_dir}/kb_chunk[s].parquet", "chunk_id string, doc_id string, doc_version string, chunk_index int")
    replace_chunks(spark, landed, f"{place}/out")
    out = spark.read.schema("chunk_id string, doc_id string, doc_version string, chunk_index int, part int").parquet(f"{place}/out")
    return out.groupBy("doc_id", "doc_version").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def stm03_session_memory(spark, sf_dir):
    return session_memory(spark, stream_files(spark, f"{sf_dir}/event[s].parquet", EVENTS))


_E = "e as (select distinct on (event_id) * from events)"
SQL = {
    "stm01_windowed_stream": f"with {_E} select date_trunc('day', ts)::timestamp as start, event_type, count(*) n, round(sum(value), 4) total from e group by 1, 2",
    "stm02_replaced_chunks": "select doc_id, doc_version, count(distinct chunk_id) n_chunks from kb_chunks where doc_id is not null group by 1, 2",
    "stm03_session_memory": f"with {_E}, n as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) back, count(*) over (partition by user_id) n, max(ts) over (partition by user_id) last from e) select user_id, string_agg(event_id::varchar, ',' order by event_id) kept, case when n > 10 then n - 5 else 0 end n_summarised from n where (n <= 10 or back <= 5) and ts >= last - interval 30 day group by user_id, n",
}
QUERIES = {n: globals()[n] for n in SQL}
