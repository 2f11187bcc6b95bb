"""JSON-lines tables: one object per line, UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.text import is_blank
from claimlens.operators.validation import validate

CORRUPT = "_corrupt_record"

def example_schema() -> T.StructType:
    """Schema of a claim-level example."""
    text = (
        "id", "question", "context", "answer", "claim", "label", "hallucination_score:double",
        "error_type", "evidence_span", "explanation", "decision", "source_type", "split",
        "claim_index:int", "claim_count_in_answer:int", "context_source_count:int",
        "context_truncated:boolean", "evidence_source_index:int", "generator_model",
        "prompt_version", "annotator_id", "annotation_confidence:double", "annotation_round:int",
        "domain", "notes", "web_evidence", "web_support", "llm_consistency", "document_support",
        "external_support", "final_label",
    )
    kinds = {"double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    fields = []
    for item in text:
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name, kinds.get(kind, T.StringType())))
    return T.StructType(fields)


# Defaults of optional example fields that are missing in a record.
EXAMPLE_DEFAULTS = {
    "evidence_span": "", "claim_index": 0, "claim_count_in_answer": 1, "context_source_count": 1,
    "context_truncated": False, "evidence_source_index": 0, "prompt_version": "v1.0",
    "annotation_round": 1, "domain": "other", "notes": "",
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``file`` and ``line``, the number of each line in its file, from 1.

    Lines are counted per block that a task reads; a line's number is what earlier blocks of its
    file hold plus its place in its own, so no file passes through one task.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = lines.groupBy("file", "_block").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    blocks = blocks.select("file", "_block", "_first", before.alias("_before"))
    return lines.join(blocks, ["file", "_block"]).select(
        "value", "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line")
    )


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, line and message of malformed ones) of a numbered, not strict read."""
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    broken = rows.where(F.col(CORRUPT).isNotNull())
    return good, broken.select("line", F.substring(CORRUPT, 1, 200).alias("message"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               strict: bool = True, numbered: bool = False) -> DataFrame:
    """Parsed lines; blank lines are skipped, but counted where lines are ``numbered``.

    Strict: a malformed line fails the job when it is reached.  Otherwise it is kept with its
    text in ``_corrupt_record``; messages quote its first 200 characters, a contract text.
    """
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path)
    lines = lines.where(~is_blank(F.col("value")))
    place = ["file", "line"] if numbered else []
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # generated, not projected: a filter on the fields would be pushed below a projection and then
    # parse the line anew for every field it reads.  The outer form adds no filter of its own.
    parsed = lines.select(*place, F.inline_outer(F.array(record)))
    if not strict:
        return parsed
    broken = F.concat(F.lit("Invalid JSON line: "), F.substring(CORRUPT, 1, 200))
    checked = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(broken)).otherwise(F.lit(True))
    return parsed.where(checked).drop(CORRUPT)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def load_examples(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid examples, quarantined rows).

    Strict: any bad line aborts with the count and one example, found in one aggregation.
    """
    raw = read_jsonl(spark, path, example_schema(), strict=False)
    filled = raw.fillna(EXAMPLE_DEFAULTS)
    checked = validate(filled)
    good = F.col(CORRUPT).isNull() & F.col("is_valid")
    if strict:
        text = F.coalesce(CORRUPT, F.concat_ws(" ", "id", F.get("errors", F.lit(0))["error"]))
        bad = checked.where(~good).agg(F.count("*").alias("n"), F.min(text).alias("first")).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} invalid line(s) in {path}; for example: {bad['first']}")
    helpers = ("errors", "is_valid", "score_warning", CORRUPT)
    return checked.where(good).drop(*helpers), checked.where(~good)
