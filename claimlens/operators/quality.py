"""Filters and quality gates over text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.claims import fragment_reason
from claimlens.functions.text import WORD, WS_CHARS, strip, word_count
from claimlens.operators.splits import sample_n


def article_ok(text: Column, min_words: int = 500, stubs=fv.STUB_PATTERNS,
               disambiguation=fv.DISAMBIGUATION_PATTERNS,
               translated=fv.MACHINE_TRANSLATION_PATTERNS) -> Column:
    """Long enough, and neither a stub, a disambiguation page nor a machine translation."""

    def unmarked(lowered: Column) -> Column:
        anywhere = "|".join([*stubs, *disambiguation])
        whole_words = "|".join(translated)
        return ~lowered.rlike(f"(?d){anywhere}") & ~lowered.rlike(
            f"(?d)(^|[^{WORD}])({whole_words})($|[^{WORD}])"
        )

    long_enough = F.coalesce(word_count(text) >= min_words, F.lit(False))
    return long_enough & let(F.lower(text), unmarked)


def paragraph_window(df: DataFrame, text: str = "text", separator: str = r"\n\n",
                     min_article_words: int = 500, min_words: int = 80,
                     max_words: int = 300) -> DataFrame:
    """Usable paragraphs (``pos``, ``paragraph``) of long articles, article columns kept."""
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    rows = df.where(word_count(F.col(text)) >= min_article_words).select(
        *[c for c in df.columns if c != text], F.posexplode(parts).alias("pos", "paragraph")
    )
    plain = ~F.startswith("paragraph", F.lit("==")) & ~F.startswith("paragraph", F.lit("*"))
    # bound once: "between" would count the words twice
    fits = let(word_count(F.col("paragraph")), lambda n: (n >= min_words) & (n <= max_words))
    return rows.where(plain & fits)


def cap_paragraphs(df: DataFrame, article: str, domain: str, per_article: int | None,
                   per_domain: int | None, order: str = "pos") -> DataFrame:
    """First paragraphs per article, then first per domain in article order; None keeps all.

    Both windows only ask for the first rows, which Spark prunes before shuffling.
    """
    by_article = Window.partitionBy(article).orderBy(order)
    by_domain = Window.partitionBy(domain).orderBy(article, order)
    return (
        df.withColumn("article_rank", F.row_number().over(by_article))
        .where(F.lit(True) if per_article is None else F.col("article_rank") <= per_article)
        .withColumn("domain_rank", F.row_number().over(by_domain))
        .where(F.lit(True) if per_domain is None else F.col("domain_rank") <= per_domain)
    )


def with_claim_quality(df: DataFrame, claim: str = "claim",
                       endings=fv.FRAGMENT_ENDINGS) -> DataFrame:
    return df.withColumn("filter_reason", fragment_reason(F.col(claim), endings))


def clean_claims(df: DataFrame, claim: str = "claim",
                 endings=fv.FRAGMENT_ENDINGS) -> tuple[DataFrame, DataFrame]:
    """(kept rows, quarantined rows with ``filter_reason``)."""
    marked = with_claim_quality(df, claim, endings)
    kept = marked.where(F.col("filter_reason").isNull()).drop("filter_reason")
    return kept, marked.where(F.col("filter_reason").isNotNull())


def reason_counts(df: DataFrame, claim: str = "claim", endings=fv.FRAGMENT_ENDINGS) -> DataFrame:
    """Rows per kind of reason; lengths inside the reason text are dropped first."""
    kind = F.coalesce(F.regexp_replace("filter_reason", r" \([0-9]+ \w+\)$", ""), F.lit("kept"))
    marked = with_claim_quality(df, claim, endings)
    return marked.groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


def prose_only(df: DataFrame, context: str = "context") -> DataFrame:
    return df.where(~F.startswith(F.ltrim(F.col(context), F.lit(WS_CHARS)), F.lit("{")))


def reject_reason(context: Column, question: Column, answer: Column,
                  question_required: bool = True) -> Column:
    """First reason to refuse a request, null when it is fine."""

    def too_short(c: Column, n: int) -> Column:
        return F.coalesce(F.length(c) < n, F.lit(True))

    question_rule = too_short(question, 3) if question_required else F.lit(False)
    return (
        F.when(too_short(context, 5), F.lit("context too short"))
        .when(question_rule, F.lit("question too short"))
        .when(too_short(answer, 3), F.lit("answer too short"))
    )


def admit_requests(df: DataFrame, question_required: bool = True) -> DataFrame:
    reason = reject_reason(
        F.col("context"), F.col("question"), F.col("answer"), question_required
    )
    return df.withColumn("reject_reason", reason)


def split_filter(df: DataFrame, split: str | None = None, limit: int | None = None,
                 id_col: str = "id") -> DataFrame:
    """Rows of a split; with ``limit`` the same hash-drawn rows on every run."""
    out = df.where(F.col("split") == split) if split else df
    return sample_n(out, limit, id_col=id_col) if limit else out
