"""Event-time bookkeeping in written tables, so that no row of a stream vanishes behind a watermark.

A stateful stream operator drops rows behind the watermark without a trace.  Here each micro-batch is
split before any state is touched: rows behind the watermark go to a side table, the others to the
job.  All tables are folders per batch that a repeated batch replaces, so a restart changes nothing:

    book/   one row per batch: the watermark it was judged by, the next one, rows in, kept, late
    late/   rows behind the watermark of their batch, or without event time
    kept/   first arrivals (de-duplication), or
    parts/  partial sums and sketches of the windows that a batch changed (summary)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimlens.functions.numbers import EXACT

# Size parameter of the quantile sketches; the error of a rank is then below RANK_ERROR with 99 % confidence.
SKETCH_K = 800
RANK_ERROR = 0.01
BOOK = "batch int, mark long, next_mark long, n_in long, n_kept long, n_late long"
Step = Callable[[DataFrame, DataFrame, int, int | None], int]


def written(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table of batch folders; empty before the first batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def book(spark: SparkSession, path: str) -> DataFrame:
    return written(spark, f"{path}/book", BOOK)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def run_split(stream: DataFrame, path: str, checkpoint: str, step: Step, ts: str = "ts",
              late: str = "1 hour") -> StreamingQuery:
    """Process everything available; ``step(on_time, behind, batch_id, mark)`` returns the rows it kept.

    The watermark of a batch is the greatest event time of all earlier batches less ``late``, in
    microseconds; it is read from the book, so it outlives the query.  The first batch has none.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        mark = book(spark, path).where(F.col("batch") < batch_id).agg(F.max("next_mark")).first()[0]
        late_here = micros(ts).isNull() | (micros(ts) < F.lit(mark) if mark is not None else F.lit(False))
        behind = rows.where(late_here)
        behind.withColumn("mark", F.lit(mark).cast("long")).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        n_kept = step(rows.where(~late_here), behind, batch_id, mark)
        found = rows.agg(F.count("*").alias("n_in"), F.count(F.when(late_here, 1)).alias("n_late"),
                         F.max(F.col(ts).cast("timestamp")).alias("top"))
        own = F.unix_micros(F.col("top") - F.expr(f"interval {late}"))
        line = found.select(F.lit(mark).cast("long").alias("mark"),
                            F.greatest(F.lit(mark).cast("long"), own).alias("next_mark"),
                            "n_in", F.lit(n_kept).cast("long").alias("n_kept"), "n_late")
        line.write.mode("overwrite").parquet(f"{path}/book/batch={batch_id}")
        rows.unpersist()

    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_dedupe(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", ts: str = "ts",
               late: str = "1 hour") -> DataFrame:
    """First arrival per id, and what came too late to be judged.

    Returns the rows of ``stream`` with ``outcome``: ``kept`` or ``late``; rows that repeat an id
    are the rest of ``n_in`` in the book.  An id is remembered until the watermark has passed its
    event time by ``late``; of one batch's rows of an id the earliest by event time counts (null ids
    are one id).  The join with remembered ids reads their two columns of files whose event times
    may still matter.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def step(on_time: DataFrame, behind: DataFrame, batch_id: int, mark: int | None) -> int:
        first = on_time.groupBy(id_col).agg(F.min_by(F.struct(*schema.names), F.struct(ts)).alias("row")).select("row.*")
        known = written(spark, f"{path}/kept", StructType([*schema.fields]).add("batch", "integer")).where(
            F.col("batch") < batch_id)
        if mark is not None:
            known = known.where(F.col(ts) + F.expr(f"interval {late}") >= F.timestamp_micros(F.lit(mark)))
        ids = known.select(F.col(id_col).alias("_known"))
        target = f"{path}/kept/batch={batch_id}"
        first.join(ids, F.col(id_col).eqNullSafe(F.col("_known")), "left_anti").write.mode("overwrite").parquet(target)
        return spark.read.schema(schema).parquet(target).count()

    run_split(stream, path, checkpoint, step, ts, late)
    kept = written(spark, f"{path}/kept", schema).select(*schema.names, F.lit("kept").alias("outcome"))
    side = written(spark, f"{path}/late", schema).select(*schema.names, F.lit("late").alias("outcome"))
    return kept.union(side)


def window_parts(rows: DataFrame, is_late: Column, ts: str, window: str, slide: str | None,
                 keys: tuple[str, ...], value: str) -> DataFrame:
    """Partial results of each window and key that merge in any order."""
    parts = rows.withColumn("_late", is_late).where(F.col(ts).isNotNull()).groupBy(
        F.window(F.col(ts).cast("timestamp"), window, slide).alias("w"), *keys)
    return parts.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_late"), 1)).alias("n_late"),
        F.sum(F.col(value).cast(EXACT)).alias("total"), F.count(value).alias("n_values"),
        F.max(value).alias("most"), F.count("is_correct").alias("n_with_gold"),
        F.count(F.when(F.col("is_correct"), 1)).alias("n_correct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"),
    ).select(F.col("w.start").alias("window_start"), *keys, "n", "n_late", "total", "n_values", "most",
             "n_with_gold", "n_correct", "sketch")


def merged(parts: DataFrame, keys: tuple[str, ...], shares: dict[str, float]) -> DataFrame:
    """Windows from the parts of all batches; quantiles from merged sketches.

    A quantile's rank is off by less than ``RANK_ERROR`` with 99 % confidence, and exact while a
    window has fewer than ``SKETCH_K`` values; without values it is null.
    """
    whole = parts.groupBy("window_start", *keys).agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late"),
        (F.sum("total").cast("double") / F.nullif(F.sum("n_values"), F.lit(0))).alias("avg_score"),
        F.max("most").alias("max_score"), F.sum("n_with_gold").alias("n_with_gold"),
        F.sum("n_correct").alias("n_correct"), F.sum("n_values").alias("_values"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_sketch"))
    picked = [F.when(F.col("_values") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))).alias(name)
              for name, p in shares.items()]
    return whole.select("*", *picked).drop("_sketch", "_values")


def run_windows(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", window: str = "1 day",
                slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("decision",),
                value: str = "hallucination_score", shares: dict[str, float] | None = None) -> DataFrame:
    """Counts, mean, maximum, accuracy and quantiles per window and key over all rows that came.

    A batch writes the parts of the windows it changed, late rows among them: they correct their
    window once, however often the batch is repeated, and ``n_late`` tells how many did.  Rows
    without event time belong to no window and are in the side table only.  No state is kept in
    the stream; a part has one row per window and key that its batch touched.
    """
    spark = stream.sparkSession

    def step(on_time: DataFrame, behind: DataFrame, batch_id: int, mark: int | None) -> int:
        rows = on_time.withColumn("_behind", F.lit(False)).union(behind.withColumn("_behind", F.lit(True)))
        parts = window_parts(rows, F.col("_behind"), ts, window, slide, keys, value)
        parts.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        return on_time.count()

    run_split(stream, path, checkpoint, step, ts, late)
    return merged(spark.read.parquet(f"{path}/parts"), keys, shares or {"p50": 0.5, "p95": 0.95})
