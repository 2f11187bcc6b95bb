"""Turkish literals and edge cases of the text rules."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from claimlens.catalog import views
from claimlens.functions import claims as cl
from claimlens.functions import context as cx
from claimlens.functions import text as t
from claimlens.functions.arrays import running_sum


def test_turkish_case(one):
    assert one(t.turkish_lower(F.lit("İSTANBUL IĞDIR"))) == "istanbul ığdır"
    assert one(t.turkish_upper(F.lit("istanbul ığdır"))) == "İSTANBUL IĞDIR"


def test_normalize_composes_and_collapses(one):
    assert one(t.normalize_text(F.lit("  école  \n x "))) == "école x"
    assert one(t.normalize_text(F.lit(None).cast("string"))) is None


def test_words_split_at_any_white_space(one):
    assert one(t.words(F.lit(" a b\tc d "))) == ["a", "b", "c", "d"]
    assert one(t.estimate_tokens(F.lit("bir iki üç"))) == 4


def test_truncate(one):
    assert one(t.truncate_words(F.lit("a  b c"), 3)) == "a  b c"
    assert one(t.truncate_words(F.lit("a  b c"), 2)) == "a b ..."


def test_keyword_overlap_drops_stopwords(one):
    got = one(t.keyword_overlap(F.lit("Python için büyük dil"), F.lit("python dili")))
    assert got == 1.0  # only "python" is a keyword
    assert one(t.keyword_overlap(F.lit("ve ile"), F.lit("ve"))) == 0.0


def test_token_f1(one):
    assert one(t.token_f1(F.lit("a b c"), F.lit("b c d e"))) == pytest.approx(0.5714)
    assert one(t.token_f1(F.lit(""), F.lit("a"))) == 0.0


def test_span_in_context(one):
    assert one(t.span_in_context(F.lit(" ISPARTA "), F.lit("ısparta ili"))) is True
    assert one(t.span_in_context(F.lit(""), F.lit("x"))) is False


def test_search_term(one):
    assert one(t.search_term(F.lit("yazar Yaşar Kemal ve Orhan"))) == "Yaşar Kemal"
    assert one(t.search_term(F.lit("bir iki üç dört"))) == "bir iki üç"
    assert one(t.search_term(F.lit("Abc sonra Xyz"))) == "Abc"


def test_two_sentences(one):
    got = one(cl.extract_claims(F.lit("İnce Memed 1955'te yayımlandı. Yaşar Kemal yazdı.")))
    assert got == ["İnce Memed 1955'te yayımlandı.", "Yaşar Kemal yazdı."]


def test_abbreviations_do_not_split(one):
    got = one(cl.extract_claims(F.lit("Kitabı Prof. Dr. Ahmet Yılmaz yazdı. Sonra ödül aldı!")))
    assert got == ["Kitabı Prof. Dr. Ahmet Yılmaz yazdı.", "Sonra ödül aldı!"]
    # an abbreviation is a whole word
    got = one(cl.extract_claims(F.lit("Bunu ŞDr. Burada kimse bilmiyor.")))
    assert got == ["Burada kimse bilmiyor."]


def test_compound_split(one):
    text = "Ankara başkenttir oysa İstanbul en büyük şehirdir"
    assert one(cl.split_compound(F.lit(text))) == [
        "Ankara başkenttir", "İstanbul en büyük şehirdir"
    ]
    short = "Kısa oysa İstanbul en büyük şehirdir"
    assert one(cl.split_compound(F.lit(short))) == [short]


def test_weak_conjunction_needs_two_entities(one):
    years = "Savaş 1914 yılında başladı ve 1918 yılında bitti"
    assert one(cl.split_compound(F.lit(years))) == [
        "Savaş 1914 yılında başladı", "1918 yılında bitti"
    ]
    versions = "HTTP/1.1 metin tabanlıdır ve HTTP/2 ikilidir"
    assert len(one(cl.split_compound(F.lit(versions)))) == 2
    plain = "Ali eve gitti ve Ayşe okula gitti"
    assert one(cl.split_compound(F.lit(plain))) == [plain]


def test_claim_validity(one):
    for text, ok in (("Kısa.", False), ("Bu doğru mudur acaba?", False),
                     ("Belki yarın yağmur yağar.", False), ("Yarın yağmur yağacak.", True)):
        assert one(cl.is_valid_claim(F.lit(text))) is ok


def test_claim_fallback(one):
    got = one(cl.claims_or_answer(cl.extract_claims(F.lit(" Evet. ")), F.lit(" Evet. ")))
    assert got == ["Evet."]
    assert one(cl.extract_claims(F.lit(None).cast("string"))) == []


def test_fragment_reasons(one):
    for text, reason in (
        ("kısa", "Length too short (4 chars)"), ("uzunbirkelime ikincisi",
                                                "Word count too low (2 words)"),
        ("Bu kitap onun hakkında", "Claim ends with a fragment/conjunction/postposition"),
        ("--- *** ... ,,, !!!", "No alphanumeric characters"),
        ("Bu kitap çok beğenildi.", None),
    ):
        assert one(cl.fragment_reason(F.lit(text))) == reason


def test_spans_reproduce_the_substring(spark):
    texts = ["...  Bir cümle. İkinci!? \n Üçüncü", "", "!!!", "Tek", " a.b. c "]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = rows.select("t", F.explode(cl.sentence_spans(F.col("t"))).alias("s")).collect()
    assert len(got) == 7
    for r in got:
        assert r["t"][r["s"]["start"]:r["s"]["end"]] == r["s"]["sentence"]


def test_running_sum_over_many_blocks(spark):
    n = 1000
    row = spark.range(1).select(
        running_sum(F.sequence(F.lit(1), F.lit(n)), block=7).alias("r")
    ).first()["r"]
    assert row == [i * (i - 1) // 2 for i in range(1, n + 1)]


def test_build_and_parse_context(one):
    two = F.array(F.lit("Metin 1"), F.lit(" Metin 2 "))
    built = "[Kaynak 1]: Metin 1\n\n---\n\n[Kaynak 2]: Metin 2"
    assert one(cx.build_context(two)) == built
    assert one(cx.parse_context(F.lit(built))) == ["Metin 1", "Metin 2"]
    assert one(cx.build_context(F.array(F.lit(" x ")))) == " x "
    assert one(cx.build_context(F.array().cast("array<string>"))) == ""
    assert one(cx.parse_context(F.lit(" tek "))) == ["tek"]


def test_source_index(one):
    assert one(cx.source_index(F.lit("[Kaynak 2]: 1955 yılında"))) == 1
    assert one(cx.source_index(F.lit("1955 yılında"))) is None


def test_fit_skips_the_big_chunk(one):
    def by_length(c):
        return F.length(c)

    chunks = F.array(F.lit("aaa"), F.lit("b" * 9), F.lit("cc"))
    got = one(cx.fit_chunks(chunks, F.lit(5), F.lit(""), F.lit(""), F.lit(""), by_length))
    assert got["removed_chunk_indices"] == [1] and got["remaining_chunk_count"] == 2
    got = one(cx.fit_chunks(chunks, F.lit(5), F.lit("12345"), F.lit(""), F.lit(""), by_length))
    assert got["removed_chunk_indices"] == [1, 2] and got["context"] == "aaa"


def test_words_are_what_white_space_parts(spark):
    """The class of word characters is spelled out; it is the complement of WS for every character."""
    rows = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(
        F.expr("decode(unhex('00000078' || lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert rows.where(F.col("c").rlike(f"^x{t.NOT_WS}$") == F.col("c").rlike(f"^x[{t.WS}]$")).count() == 0


def seconds(df):
    began = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def slower(spark, texts, one, other):
    """How many times as long ``one`` takes as ``other`` over the same cached texts; the best of two runs."""
    rows = texts.cache()
    rows.count()
    best = [min(seconds(rows.select(c)) for _ in range(2)) for c in (one, other)]
    rows.unpersist()
    return best[0] / best[1]


def test_counting_words_costs_about_what_one_blank_would(spark):
    text = F.repeat(F.lit("some words of a text "), 2000)
    texts = spark.range(0, 300, 1, 8).select(F.concat(F.col("id").cast("string"), text).alias("t"))
    assert slower(spark, texts, t.word_count(F.col("t")), F.regexp_count("t", F.lit("[^ ]+"))) < 6


def test_spans_do_not_read_the_text_for_every_sentence(spark):
    """Twenty thousand sentences in a text of 0.4 MB: each used to read it twice."""
    texts = spark.range(0, 8, 1, 8).select(
        F.concat(F.col("id").cast("string"), F.repeat(F.lit(" A sentence it is."), 20_000)).alias("t"))
    found = texts.select(cl.sentence_spans(F.col("t")).alias("s"))
    assert found.select(F.size("s").alias("n")).distinct().collect()[0].n == 20_000
    assert seconds(found) < 10


def test_letters_of_raw_outputs_are_joined_not_replaced(spark, sf_dir):
    plan = views.raw_outputs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
