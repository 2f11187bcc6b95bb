"""Registered queries of the llm operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.catalog.registry import Query
from claimlens.llm import (
    bpe, chat, decontaminate, fill_in_middle, html_text, language, licenses, ngram_join, spelling,
    suffix_dedup, token_shards, topk, toxicity,
)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written to indexed shards, and what the shards give back."""
    path = token_shards.write_shards(table(spark, folder, "documents"), byte_bpe())
    return token_shards.read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard", "slot")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat an earlier string of 100 bytes."""
    return suffix_dedup.removed(table(spark, folder, "documents"))


@query("op3_ngram_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of near copies of every document."""
    return ngram_join.join(table(spark, folder, "documents"))


@query("op4_decontaminate")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that windows of benchmark items hit."""
    found = decontaminate.matches(table(spark, folder, "documents"),
                                  table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query("op5_chat")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted, written and read back."""
    odd = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return chat.read_back(spark.read.parquet(chat.write_examples(turns)))


@query("op6_html_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


@query("op7_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q),
  lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best vectors of every twentieth one."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encode_decode(table(spark, folder, "documents"), byte_bpe())


@query("op9_licenses", licenses.scan_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of the list in the SQL that a whole document, or a line of it, is."""
    return licenses.scan(table(spark, folder, "documents"), licenses.known_digests(spark))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    learnt = language.fit(docs.where(~held_out()))
    return language.predict(docs, learnt).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def unseen_label(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@query("op11_toxicity")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, labels learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    classifier, _, _ = toxicity.fit(docs, table(spark, folder, "labels"), ~unseen_label())
    return toxicity.score(docs, classifier).select("doc_id", unseen_label().alias("held_out"), "score", "predicted")


@query("op12_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    xor(c >> 1, (c & 1) * 3988292384), i)) AS step),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT run, length(run) AS k, count(*) AS n, encode(id || ':' || run) AS seen FROM runs
  WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, k, n, xor(4294967295, list_reduce(list_transform(range(octet_length(seen)),
    lambda i: CAST('0x' || substring(hex(seen), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM counted CROSS JOIN crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % k) || substring(run, h % k + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS MATERIALIZED (SELECT word, n, p, substring(word, 1, p) || substring(word, p + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p
    AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM pairs GROUP BY word),
named AS (SELECT word, any_value(n_near) AS n_near, any_value(form_n) AS form_n, min(near) AS form
  FROM best JOIN pairs USING (word) WHERE near_n = form_n GROUP BY word),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
  CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN named USING (word)),
way AS (SELECT word, word AS at FROM judged
  UNION ALL SELECT way.word, judged.form FROM way JOIN judged ON way.at = judged.word WHERE judged.form IS NOT NULL)
SELECT j.word, j.form, way.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN way USING (word)
JOIN judged last ON last.word = way.at WHERE last.form IS NULL""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_fill_in_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
  CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars,
  CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END
  ) AS output_sha256, sha256(t) AS restored_sha256 FROM c""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in its fill-in-the-middle form, and restored from it."""
    return fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
