"""Request streams.

Decisions are stateless projections; only windowed summaries and de-duplication keep state,
bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlens.functions.numbers import exact_mean
from claimlens.operators.validation import validate
from claimlens.plans.detect import detect


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less timestamps cannot carry a watermark; read them in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_detect(requests: DataFrame, **options) -> DataFrame:
    """One decision per request; the same columns as the batch plan, append mode."""
    return detect(requests, **options)


def stream_summary(decisions: DataFrame, ts: str = "ts", window: str = "1 day",
                   slide: str | None = None, late: str = "1 hour",
                   keys: tuple[str, ...] = ("decision",)) -> DataFrame:
    """Count, mean and maximum score and accuracy per time window and key.

    On a stream, rows behind the watermark are dropped by the engine once state crosses batches;
    ``late.run_windows`` keeps and counts them.
    """
    bounded = decisions
    if decisions.isStreaming:
        bounded = decisions.withWatermark(ts, late)
    grouped = bounded.groupBy(F.window(ts, window, slide), *keys).agg(
        F.count("*").alias("n"),
        exact_mean(F.col("hallucination_score")).alias("avg_score"),
        F.max("hallucination_score").alias("max_score"),
        F.count("is_correct").alias("n_with_gold"),
        F.count(F.when(F.col("is_correct"), 1)).alias("n_correct"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), *keys, "n", "avg_score", "max_score",
        "n_with_gold", "n_correct",
    )


def stream_dedupe(requests: DataFrame, id_col: str = "id", ts: str = "ts",
                  late: str = "1 hour") -> DataFrame:
    """First arrival per id within the watermark; state is dropped once it has passed.

    Rows behind the watermark are dropped too; ``late.run_dedupe`` reports them in a side table.
    """
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def stream_validate(examples: DataFrame, good_path: str, quarantine_path: str,
                    checkpoint: str) -> StreamingQuery:
    """Route rows to a good and a quarantine table, once per batch even after a restart.

    Each batch replaces its own folder, so a repeated batch does not duplicate rows.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        checked = validate(batch).persist()
        helpers = ("is_valid", "score_warning")
        checked.where("is_valid").drop("errors", *helpers).write.mode("overwrite").parquet(
            f"{good_path}/batch={batch_id}"
        )
        checked.where("not is_valid").drop(*helpers).write.mode("overwrite").parquet(
            f"{quarantine_path}/batch={batch_id}"
        )
        checked.unpersist()

    return (
        examples.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_summary(stream: DataFrame, path: str, checkpoint: str,
                keys: tuple[str, ...] = ("decision",)) -> DataFrame:
    """Process everything available; returns all windows, also those still open at the end.

    Rows that the watermark has passed are not in them (see ``late.run_windows``).  Each batch writes the windows it changed to a folder of its own, which a repeated batch
    replaces; of a window the newest batch counts.  State stays bounded by the watermark.
    """

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    newest = rows.groupBy("window_start", *keys).agg(F.max("batch").alias("_newest"))
    same = rows["batch"] == newest["_newest"]
    for name in ("window_start", *keys):
        same = same & rows[name].eqNullSafe(newest[name])
    return rows.join(newest, same, "left_semi").drop("batch")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append it to a parquet table."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
