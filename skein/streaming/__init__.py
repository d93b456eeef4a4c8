"""Structured Streaming forms: event-time windows, sessions and the keyed ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern as path takes either, a plain one only folders."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its zoneless times are taken as the session's zone, as a watermark needs one."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def finish(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its result table, which is written to the shared folder batch by batch.

    In complete mode each batch is the whole result, so the last one counts; in the others all batches together do.
    """
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/skein-stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        done.append(number)

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    _delete_on_exit(spark, at, f"{at}-checkpoint")
    parts = [f"{at}/batch={n}" for n in (done[-1:] if mode == "complete" else done)]
    return spark.read.schema(df.schema).parquet(*parts) if parts else spark.createDataFrame([], df.schema)


def _delete_on_exit(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def windows(stream: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Count and sum of each event type in tumbling or sliding windows, late by a day at most."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = stream.withWatermark("ts", "1 day").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round(F.col("total").cast("double"), 3).alias("total"))


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    out = stream.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def progress(stream: DataFrame, total: int) -> DataFrame:
    """Running count of each user and whether it has reached a total."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("state", F.when(F.col("n") >= total, "done").otherwise("progress"))


#: Key buckets of a ledger; a batch rewrites those it touches.
BUCKETS = 64


def current_buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """The newest version of each bucket of a ledger, as written by batches before a number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for batch in files.listStatus(root) if files.exists(root) else []:
        name = batch.getPath().getName()
        if name.startswith("batch=") and (before is None or int(name[6:]) < before):
            for part in files.listStatus(batch.getPath()):
                if part.getPath().getName().startswith("bucket="):
                    b = int(part.getPath().getName()[7:])
                    newest[b] = max(newest.get(b, -1), int(name[6:]))
    return {b: f"{target}/batch={n}/bucket={b}" for b, n in newest.items()}


def ledger_last_wins(stream: DataFrame, target: str) -> None:
    """Keyed upserts by batch: of each (user, type), the change of the largest event_id; only touched buckets are rewritten.

    A batch that is repeated after a failure reads the versions before it and overwrites its own, so it changes nothing twice.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        now = batch.select("user_id", "event_type", "event_id", "value", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        touched = [r[0] for r in now.select("bucket").distinct().collect()]
        known = current_buckets(spark, target, number)
        old = [spark.read.parquet(known[b]).withColumn("bucket", F.lit(b)) for b in touched if b in known]
        for o in old:
            now = now.unionByName(o)
        merged = now.groupBy("bucket", "user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """The ledger as it stands: the newest version of every bucket."""
    return spark.read.parquet(*current_buckets(spark, target).values())


def conversation_memory(turns: DataFrame, keep: int = 20, every: int = 5) -> DataFrame:
    """Per conversation over a stream of turns: how many there were, the last `keep` and how often a summary fell due; a row for
    each batch that adds turns, the one with the most turns stands.

    turns: conv_id, turn, role. The last are those of the largest number, in whatever order they come; turns without a number
    only count. The state of a conversation is bounded by `keep` turns.
    """
    from pyspark.sql.streaming.state import GroupState

    def fold(key, frames, state: GroupState):
        import pandas as pd

        count, last = state.get if state.exists else (0, [])
        last = [int(x) for x in last]
        for f in frames:
            count, last = count + len(f), sorted([*last, *map(int, f["turn"].dropna().tolist())])[-keep:]
        state.update((count, last))
        first = pd.array([last[0] if last else None], dtype="Int64")
        yield pd.DataFrame({"conv_id": pd.array([key[0]], dtype="Int64"), "turns": [count], "first_kept": first, "kept": [min(count, keep)], "summaries": [count // every]})

    out, held = "conv_id long, turns long, first_kept long, kept int, summaries long", "count long, last array<long>"
    return turns.groupBy("conv_id").applyInPandasWithState(fold, out, held, "update", "NoTimeout")


def dead_letters(rows: DataFrame, good: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and those that do not, with the reason and their JSON: the queue that a retry reads."""
    ok = F.coalesce(good, F.lit(False))
    return rows.where(ok), rows.where(~ok).select(reason.alias("reason"), F.to_json(F.struct(*rows.columns)).alias("payload"))


def retried(letters: DataFrame, done: DataFrame, schema: str, key: str) -> DataFrame:
    """Payloads of the queue whose key has not been done since."""
    back = letters.select(F.from_json("payload", schema).alias("p")).select("p.*")
    return back.join(done.select(key).distinct(), key, "left_anti")
