"""Text normalisation, tokens and overlap ratios as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimlens import fixed_values as fv
from claimlens.functions.arrays import any_contains, let, literal_array
from claimlens.functions.numbers import ratio, round_to

# Unicode white space spelled out: Java's \s is ASCII only, and trim() only strips blanks.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# All else, spelled out with the common characters first: a negated class asks every range for each character.
NOT_WS = (
    r"[!-\x{84}\x{0}-\x08\x0E-\x1B\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]"
)
WS_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{NOT_WS}+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NOT_WS}+"))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, fv.TURKISH_UPPER_CHARS, fv.TURKISH_LOWER_CHARS))


def turkish_upper(c: Column) -> Column:
    return F.upper(F.translate(c, fv.TURKISH_LOWER_CHARS, fv.TURKISH_UPPER_CHARS))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_text(c: Column) -> Column:
    """NFC, strip, collapse white space.

    Text below U+0300 is already in NFC, so only other rows are handed to Python;
    the rest cross the Arrow boundary as nulls.
    """
    needs_python = c.rlike(r"[^\x{0}-\x{2FF}]")
    composed = F.coalesce(_nfc(F.when(needs_python, c)), c)
    return F.regexp_replace(strip(composed), f"[{WS}]+", " ")


def estimate_tokens(c: Column, factor: float = fv.TOKENS_PER_WORD) -> Column:
    return F.floor(word_count(c) * F.lit(factor)).cast("int")


def truncate_words(c: Column, n: int) -> Column:
    return let(
        words(c),
        lambda w: F.when(F.size(w) <= n, c).otherwise(
            F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" ..."))
        ),
    )


def token_set(c: Column, min_len: int = 1, stopwords=()) -> Column:
    """Distinct lower-case word tokens of at least ``min_len`` characters."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]{{{min_len},}}"), F.lit(0))
    found = F.array_distinct(found)
    return F.array_except(found, literal_array(stopwords)) if stopwords else found


def share_of(a: Column, b: Column) -> Column:
    """|A intersect B| / |A| for two token sets, 0 when A is empty.

    The second argument of array_intersect is hashed; A is the short one here.
    """
    return ratio(F.size(F.array_intersect(b, a)), F.size(a))


def keyword_overlap(text: Column, context: Column, min_len: int = 4,
                    stopwords=fv.STOPWORDS) -> Column:
    b = token_set(context, min_len, stopwords)
    return let(token_set(text, min_len, stopwords), lambda a: share_of(a, b))


def token_overlap_ratio(a: Column, b: Column, min_len: int = 3) -> Column:
    return keyword_overlap(a, b, min_len, ())


def plain_tokens(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two token sets, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return let(
        shared,
        lambda i: F.when(
            (F.size(a) > 0) & (F.size(b) > 0), ratio(i, F.size(a) + F.size(b) - i)
        ).otherwise(F.lit(0.0)),
    )


def token_jaccard(a: Column, b: Column) -> Column:
    return let(plain_tokens(a), lambda x: let(plain_tokens(b), lambda y: jaccard(x, y)))


def token_f1(pred: Column, gold: Column) -> Column:
    """Set F1 of Turkish-lowered tokens; 2i/(|P|+|G|) needs one division only."""

    def score(p: Column, g: Column) -> Column:
        shared = F.size(F.array_intersect(p, g))
        return F.when(
            (F.size(p) > 0) & (F.size(g) > 0),
            round_to(ratio(shared * 2, F.size(p) + F.size(g)), 4),
        ).otherwise(F.lit(0.0))

    def toks(c: Column) -> Column:
        return F.array_distinct(words(turkish_lower(c)))

    return let(toks(pred), lambda p: let(toks(gold), lambda g: score(p, g)))


def span_in_context(span: Column, context: Column) -> Column:
    hit = F.contains(turkish_lower(context), turkish_lower(strip(span)))
    present = (F.length(span) > 0) & (F.length(context) > 0)
    return F.coalesce(present & hit, F.lit(False))


def search_term(c: Column) -> Column:
    """Longest run of capitalised words (first on ties), else the first three words."""
    word = f"[{fv.CAPITALS}][{fv.SMALLS}{fv.CAPITALS}]+"
    runs = F.regexp_extract_all(c, F.lit(f"{word}(?:[{WS}]+{word})*"), F.lit(0))
    ranked = F.transform(runs, lambda r, i: F.struct(F.length(r), -i, r.alias("run")))
    return F.coalesce(
        F.array_max(ranked)["run"], F.array_join(F.slice(words(c), 1, 3), " ")
    )


def ends_with_word(c: Column, endings) -> Column:
    """Last word is one of ``endings``, ignoring case; word boundaries are spelled out."""
    alternatives = "|".join(endings)
    return c.rlike(f"(?iu)(^|[^{WORD}])({alternatives})[{WS}]*$")


def has_word(c: Column, alternatives) -> Column:
    body = "|".join(alternatives)
    whole = c.rlike(f"(^|[^{WORD}])({body})($|[^{WORD}])")
    # plain words are looked for as such first; few texts get as far as the edges
    if all(re.fullmatch(r"[\w ]+", a) for a in alternatives):
        return any_contains(c, alternatives) & whole
    return whole


def cut(c: Column, n: int, tail: str = "") -> Column:
    """First n characters, plus ``tail`` when something was cut off."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(head, F.lit(tail))).otherwise(c) if tail else head
