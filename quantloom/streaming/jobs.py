"""Structured Streaming jobs, each with the batch form that its final table equals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.scratch import scratch_path


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now, into a new table in the shared folder; return the table.

    Checkpoint and output live under spark.checkpoint.dir, so a restarted driver or a lost executor goes on
    from the last batch.
    """
    spark = stream.sparkSession
    base = scratch_path(spark)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def upserted(stream: DataFrame, path: str, keys: list[str], order: str, mode: str = "append") -> None:
    """Fold a stream of rows into a keyed table at path, the row with the largest order winning; each batch
    writes a new version next to the old one, named by batch id, so a repeated batch changes nothing."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        old = f"{path}/v{number - 1}"
        rows = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str) -> str:
    """The folder of the last version that upserted or incremental_index has written under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    number = F.regexp_extract("path", r"/v(\d+)/part-[^/]*$", 1).try_cast("int")
    return f"{path}/v{files.agg(F.max(number)).first()[0]}"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def snapshot_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): index what is new or has another time, delete what is gone, skip the rest."""
    met = old.select("path", F.col("mtime").alias("was")).join(new.select("path", F.col("mtime").alias("now")), "path", "full")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "index new").when(F.col("was") != F.col("now"), "index changed").otherwise("skip")
    return met.select("path", action.alias("action"))


def cursor_fetch(items: DataFrame, cursor: Column, most: int, order: list[str]) -> DataFrame:
    """The first `most` items of the cursor's day or later; items of that day come again, so a sink must be
    idempotent."""
    return items.where(F.to_date("ts") >= F.to_date(cursor)).orderBy(*order).limit(most)


def deduplicated_stream(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One row for each key; keys are forgotten once the watermark has passed."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def task_states(log: DataFrame) -> DataFrame:
    """(task_id, status, changes, since): the last status of each task, by time and then event."""
    last = log.groupBy("task_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("l"), F.count("*").alias("changes"))
    return last.select("task_id", F.col("l.status").alias("status"), "changes", F.col("l.ts").alias("since"))


def task_state_stream(log: DataFrame) -> DataFrame:
    """As task_states on a stream: state holds one row for each task, updates come with every batch."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        ts, event, status, changes = state.get if state.exists else (pd.Timestamp(0), -1, "", 0)
        for rows in batches:
            changes += len(rows)
            row = rows.sort_values(["ts", "event_id"]).iloc[-1]
            if (row["ts"], row["event_id"]) > (ts, event):
                ts, event, status = row["ts"], int(row["event_id"]), row["status"]
        state.update((ts, event, status, changes))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "changes": [changes]})

    return log.groupBy("task_id").applyInPandasWithState(step, "task_id bigint, status string, changes bigint", "ts timestamp, event_id bigint, status string, changes bigint", "update", "NoTimeout")


def watched_states(log: DataFrame, limit: str, running: str = "processing", failed: str = "failed", late: str = "1 hour") -> DataFrame:
    """As task_states on one batch, where a task that has been `running` for longer than `limit`, as of the newest
    time less `late`, counts as `failed`."""
    newest = log.agg(F.max("ts").alias("_newest"))
    over = F.col("since").cast("timestamp") + F.expr(f"interval {limit}") < F.col("_newest").cast("timestamp") - F.expr(f"interval {late}")
    out = task_states(log).join(F.broadcast(newest))  # one row
    return out.withColumn("status", F.when((F.col("status") == running) & over, failed).otherwise(F.col("status"))).drop("_newest")


def watched_state_stream(log: DataFrame, limit: str, running: str = "processing", failed: str = "failed", late: str = "1 hour") -> DataFrame:
    """(task_id, status, changes, rev): watched_states on a stream, in update mode; of a task's rows the largest
    rev is the newest. State holds one row for each task and a timer for each running one; the timer fires once
    the watermark has passed `limit` after its last change."""
    micros = log.sparkSession.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {limit}) as m").first()["m"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        ts, event, status, changes, rev = state.get if state.exists else (-1, -1, "", 0, 0)
        if state.hasTimedOut:
            status = failed
        else:
            for rows in batches:
                changes += len(rows)
                row = rows.sort_values(["micros", "event_id"]).iloc[-1]
                if (row["micros"], row["event_id"]) > (ts, event):
                    ts, event, status = int(row["micros"]), int(row["event_id"]), row["status"]
            if status == running:
                state.setTimeoutTimestamp(max((ts + micros) // 1000, state.getCurrentWatermarkMs() + 1))
        state.update((ts, event, status, changes, rev + 1))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "changes": [changes], "rev": [rev + 1]})

    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("task_id").applyInPandasWithState(step, "task_id bigint, status string, changes bigint, rev bigint", "micros bigint, event_id bigint, status string, changes bigint, rev bigint", "update", "EventTimeTimeout")


def incremental_index(stream: DataFrame, base: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Keep an index up to date with a stream of listings (scan, path, mtime, ...): `work` is applied to new and
    changed rows only, rows of vanished paths go, all others stay as they were.

    Batch n reads the index of batch n - 1 and writes its own under base/v{n} with the counts of its actions
    under base/counts/n{n}; a batch that is repeated writes the same again, so a restart in the middle ends with
    the same index. Of several scans in one batch the last one counts. `work` keeps path and mtime.
    """
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("scan").alias("scan"))
        new = batch.join(F.broadcast(last), "scan").drop("scan")  # one row
        made = work(new)
        old = spark.read.schema(made.schema).parquet(f"{base}/v{number - 1}") if number else spark.createDataFrame([], made.schema)
        plan = snapshot_plan(old, new)
        if last.first()["scan"] is None:  # no listing in this batch
            plan = plan.withColumn("action", F.lit("skip"))
        kept = old.join(plan.where("action = 'skip'"), "path", "left_semi")
        fresh = work(new.join(plan.where("action like 'index%'"), "path", "left_semi"))
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{base}/v{number}")
        plan.groupBy("action").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/counts/n{number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def sessions(messages: DataFrame, gap: str) -> DataFrame:
    """(conv_id, first, last, messages): runs of a conversation's messages (ts a timestamp) without a pause of
    `gap`; last is the time at which the session would have been continued at the latest."""
    found = messages.groupBy(F.session_window("ts", gap).alias("w"), "conv_id").agg(F.count("*").alias("messages"))
    return found.select("conv_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "messages")


def mined_sessions(closed: DataFrame, messages: DataFrame, mine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `mine` draws from each session's messages (conv_id, turn, ts, text), with conv_id and first."""
    met = messages.withColumn("ts", F.col("ts").cast("timestamp")).join(closed.select("conv_id", "first", "last"), "conv_id").where("ts >= first and ts < last")
    found = mine(met.withColumn("conv_id", F.struct("conv_id", "first")).drop("first", "last"))
    return found.withColumn("first", F.col("conv_id.first")).withColumn("conv_id", F.col("conv_id.conv_id"))


def grow_from_sessions(stream: DataFrame, messages: Callable[[], DataFrame], base: str, gap: str, late: str, mine: Callable[[DataFrame], DataFrame], apply: bool = True) -> None:
    """Mine every session once it is closed, that is, once the watermark has passed its end.

    The stream (conv_id, ts) only finds the sessions; their messages are read from the table that `messages`
    opens, so state holds no text. Batch n writes what was mined to base/mined/n{n} and, if `apply`, the grown
    memory (line) to base/memory/v{n}; without it the mined rows are suggestions. Repeated batches write the
    same again. `mine` returns conv_id and line.
    """
    spark = stream.sparkSession

    def fold(closed: DataFrame, number: int) -> None:
        found = mined_sessions(closed, messages(), mine)
        found.write.mode("overwrite").parquet(f"{base}/mined/n{number}")
        if apply:
            lines = spark.read.schema(found.schema).parquet(f"{base}/mined/n{number}").select("line")
            old = lines.limit(0) if number == 0 else spark.read.schema(lines.schema).parquet(f"{base}/memory/v{number - 1}")
            old.unionByName(lines).distinct().write.mode("overwrite").parquet(f"{base}/memory/v{number}")

    timed = stream.select("conv_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    sessions(timed, gap).writeStream.outputMode("append").foreachBatch(fold).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Events of each key in each window; late ones count until the watermark has passed the window."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def decay_scores(items: DataFrame, access: DataFrame, now: Column, rate: float, boost: float) -> DataFrame:
    """Adds count and score: base * exp(-rate * days since the last access) * (1 + boost * ln(1 + count)),
    between 0 and 10. Items never accessed have age 0; rate and boost are kept within .001 to .1 and 0 to 2."""
    rate, boost = min(max(rate, 0.001), 0.1), min(max(boost, 0.0), 2.0)
    seen = access.groupBy("item_id").agg(F.count("*").alias("count"), F.max("ts").alias("last"))
    met = items.join(seen, "item_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    days = F.coalesce((F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000, F.lit(0.0))
    score = F.col("base") * F.exp(-rate * days) * (1 + boost * F.log1p("count"))
    return met.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)), 6)).drop("last")


def decay_cleanup(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Candidates for removal, the lowest score first."""
    return scores.where(F.col("score") < threshold).orderBy("score", "item_id")


def session_growth(messages: DataFrame, mine: Callable[[DataFrame], DataFrame], least: int = 2) -> DataFrame:
    """(conv_id, candidates): conversations from which `mine` draws `least` lines or more."""
    return mine(messages).groupBy("conv_id").agg(F.count("*").alias("candidates")).where(F.col("candidates") >= least)
