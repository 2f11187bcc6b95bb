"""Answer text -> sentences -> claims, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let, running_sum
from claimlens.functions.text import WORD, WS, has_word, strip

SENTENCE = "[^.!?]+[.!?]*"


def sentences(text: Column) -> Column:
    """Stripped, non-blank sentence strings in order."""
    raw = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(raw, strip), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def sentence_spans(text: Column) -> Column:
    """array<struct<start,end,sentence>> with 0-based, end-exclusive offsets.

    Matches tile the text after its leading terminators, so every offset is the
    length of what came before.  The length of those is bound: inside the lambda the whole
    text would be read again for every sentence.
    """
    raw = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))

    def build(lead: Column, parts: Column) -> Column:
        before = running_sum(F.transform(parts, F.length))
        zipped = F.arrays_zip(parts.alias("part"), before.alias("at"))
        spans = F.transform(
            zipped,
            lambda z: let(
                F.ltrim(z["part"], F.lit(_ws_chars())),
                lambda body: F.struct(
                    (lead + z["at"] + F.length(z["part"]) - F.length(body)).alias("start"),
                    (
                        lead + z["at"] + F.length(z["part"]) - F.length(body)
                        + F.length(strip(body))
                    ).alias("end"),
                    strip(body).alias("sentence"),
                ),
            ),
        )
        return F.filter(spans, lambda s: s["sentence"] != "")

    first = F.length(F.regexp_extract(text, "^[.!?]*", 0))
    return let(first, lambda lead: let(raw, lambda parts: build(lead, parts)))


def _ws_chars() -> str:
    from claimlens.functions.text import WS_CHARS

    return WS_CHARS


def protect_abbreviations(text: Column, abbreviations=fv.ABBREVIATIONS) -> Column:
    names = "|".join(sorted(abbreviations, key=len, reverse=True))
    pattern = f"(?<![{WORD}])({names})\\."
    return F.regexp_replace(text, pattern, f"$1{fv.DOT_PLACEHOLDER}")


def split_at(sentence: Column, position: Column, width: int) -> Column:
    """Two stripped sides of a cut at a 1-based position, or null if one is too short."""
    left = strip(F.substring(sentence, F.lit(1), position - 1))
    right = strip(F.substring(sentence, position + width, F.length(sentence)))
    long_enough = (F.length(left) >= fv.MIN_CLAIM_CHARS) & (F.length(right) >= fv.MIN_CLAIM_CHARS)
    return F.when((position > 0) & long_enough, F.array(left, right))


def multi_entity(sentence: Column) -> Column:
    """Two technology versions, two v-numbers or two years in one line."""
    tech = "(" + "|".join(fv.TECH_NAMES) + f")[{WS}]*/?[{WS}]*[0-9.]+"
    year = f"(?<![{WORD}])(1[0-9]{{3}}|20[0-9]{{2}})(?![{WORD}])"
    # every branch holds two of these in one line; most sentences do not
    twice = sentence.rlike("(?d)[0-9.].*[0-9.]")
    return twice & sentence.rlike(f"(?id){tech}.*?{tech}|v[0-9.]+.*?v[0-9.]+|{year}.*?{year}")


def split_compound(sentence: Column, conjunctions=fv.CONJUNCTIONS,
                   weak: str = fv.WEAK_CONJUNCTION) -> Column:
    """One or two parts of a sentence; the first listed conjunction with two long sides wins."""

    def strong(lowered: Column) -> Column:
        cuts = [split_at(sentence, F.instr(lowered, c), len(c)) for c in conjunctions]
        any_present = lowered.rlike("|".join(conjunctions))
        return F.when(any_present, F.coalesce(*cuts))

    weak_cut = F.when(
        F.contains(sentence, F.lit(weak)) & multi_entity(sentence),
        split_at(sentence, F.instr(sentence, weak), len(weak)),
    )
    return F.coalesce(let(F.lower(sentence), strong), weak_cut, F.array(sentence))


def is_valid_claim(claim: Column, opinion_words=fv.OPINION_WORDS) -> Column:
    return (
        (F.length(claim) >= fv.MIN_CLAIM_CHARS)
        & ~F.endswith(claim, F.lit("?"))
        & ~has_word(F.lower(claim), opinion_words)
    )


def extract_claims(answer: Column, conjunctions=fv.CONJUNCTIONS,
                   abbreviations=fv.ABBREVIATIONS, opinion_words=fv.OPINION_WORDS,
                   weak: str = fv.WEAK_CONJUNCTION) -> Column:
    """Verifiable claims of an answer, in order; empty array for null or blank text."""
    shielded = protect_abbreviations(strip(answer), abbreviations)
    parts = F.split(shielded, f"(?<=[.!?])[{WS}]+")
    restored = F.transform(
        parts, lambda s: F.replace(strip(s), F.lit(fv.DOT_PLACEHOLDER), F.lit("."))
    )
    pieces = F.flatten(F.transform(restored, lambda s: split_compound(s, conjunctions, weak)))
    kept = F.filter(F.transform(pieces, strip), lambda c: is_valid_claim(c, opinion_words))
    return F.coalesce(kept, F.array().cast("array<string>"))


def claims_or_answer(claims: Column, answer: Column) -> Column:
    """Whole stripped answer as the only claim when nothing was extracted."""
    return F.when(F.size(claims) > 0, claims).otherwise(F.array(strip(answer)))


def first_sentence_claim(answer: Column) -> Column:
    head = strip(F.substring_index(answer, ".", 1))
    return F.when(F.length(head) < fv.MIN_CLAIM_CHARS, answer).otherwise(head)


def fragment_reason(claim: Column, endings=fv.FRAGMENT_ENDINGS) -> Column:
    """First reason to discard a claim, null when it is fine."""
    from claimlens.functions.text import ends_with_word, word_count

    def reason(c: Column) -> Column:
        return (
            F.when(
                F.length(c) < 15,
                F.format_string("Length too short (%d chars)", F.length(c)),
            )
            .when(
                word_count(c) < 3, F.format_string("Word count too low (%d words)", word_count(c))
            )
            .when(
                ends_with_word(c, endings),
                F.lit("Claim ends with a fragment/conjunction/postposition"),
            )
            .when(~c.rlike(r"[\p{L}\p{N}]"), F.lit("No alphanumeric characters"))
        )

    return let(strip(F.coalesce(claim, F.lit(""))), reason)
