"""BPE and token shards against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from claimlens.llm import bpe, queries, token_shards


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_bpe())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def strings():
    rng = random.Random(1)
    letters = "ab 'sté\n\t\x1c\x85\xa0²1_-🙂‍́<|endoftext|>"
    odd = ["", "  a  b\t\n c", " a", "a ", "x<|endoftext|>y <|endoftext|>", "don't we'll ''s 12²Ⅷ3", "a" * 3000,
           "   ", "\n\n \n", "<|endoftext", "日本語 テスト 👨‍👩‍👧"]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


@pytest.mark.parametrize("make", [bpe.encoder, token_shards.library_encoder])
def test_encoders_equal_the_library(library, make):
    texts = strings()
    got = [np.frombuffer(x, "<u4").tolist() for x in make(queries.byte_bpe()).encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_equals_the_library(library):
    own = bpe.merges(queries.byte_bpe())
    for ids in ([50256, 0], [255, 128], *(library.encode(t, add_special_tokens=False).ids for t in strings()[:200])):
        assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("make", [lambda f: bpe.PieceEncoder(bpe.merges(f).encode_words, bpe.merges(f).special),
                                  token_shards.library_encoder.__wrapped__])
def test_full_stores_start_anew(library, monkeypatch, make):
    monkeypatch.setattr(bpe, "STORE_BYTES", 20_000)
    encoder = make(queries.byte_bpe())
    texts = [" ".join(f"w{i}x{j}, the\f{i} " for i in range(30)) for j in range(20)]
    got = [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.pieces.held == bpe.weight(encoder.pieces) <= encoder.pieces.limit


@pytest.mark.parametrize("make", [bpe.encoder.__wrapped__, token_shards.library_encoder.__wrapped__])
def test_stores_are_bounded_by_bytes(library, monkeypatch, make):
    monkeypatch.setattr(bpe, "STORE_BYTES", 100_000)
    encoder, rng = make(queries.byte_bpe()), random.Random(2)
    for _ in range(6):
        texts = ["".join(rng.choice("ABCDabcd0123+/") for _ in range(20_000)),  # one piece
                 " ".join("".join(rng.choice("日本語文字") for _ in range(900)) for _ in range(30))]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for store in (encoder.pieces, encoder.words):
            assert store.held == bpe.weight(store) <= store.limit and max(map(len, store), default=0) <= bpe.LONG


def test_library_encodes_a_word_once_whatever_follows_it(library):
    class Counting:
        seen = 0

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **how):
            self.seen += sum(map(len, texts))
            return library.encode_batch_fast(texts, **how)

    own = Counting()
    encoder = token_shards.LibraryEncoder(own)
    words = [f"{a}{b}{c}onder" for a in "klmnprst" for b in "aeiou" for c in "klmnprst"]
    texts = [f"Text {w}{end} more" for end in (".", ",", "***", "\nSo", "") for w in words]
    for text in texts:
        got, = encoder.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.seen < 2 * sum(len(w) + 5 for w in words) + 4 * len(texts)  # and the heads


def test_library_encoder_cuts_odd_texts_as_the_library(library):
    rng = random.Random(3)
    parts = [*" \n\t\f\x1c\x85\u2009.,'€", " ", "  ", "'s", "a", "word", "é", "字", "²", "\u0301", "***", "<|endoftext|>", "<|end"]
    encoder = token_shards.library_encoder(queries.byte_bpe())
    for _ in range(400):
        texts = ["".join(rng.choices(parts, k=rng.choice((0, 1, 3, 30)))) for _ in range(5)]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op8_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.op8(spark, sf_dir).collect()}
    assert got == {d.doc_id: expected(library, d.text) for d in docs}


def test_op8_odd_documents(odd_docs, no_docs, library):
    got = bpe.encode_decode(odd_docs, queries.byte_bpe(), with_ids=True)
    assert sorted(tuple(r)[1:4] for r in got.collect()) == sorted(
        expected(library, r.text) for r in odd_docs.select("text").collect())
    assert all(r.decoded == (r.text or "") for r in got.join(
        odd_docs.where("doc_id IN (5, 9)").select("doc_id", "text"), "doc_id").collect())
    assert bpe.encode_decode(no_docs, queries.byte_bpe()).count() == 0


def test_op1_query(spark, sf_dir, library):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in queries.op1(spark, sf_dir).collect()}
    start = 0
    for d in docs:
        ids = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_op1_odd_documents(spark, odd_docs, no_docs, library):
    path = token_shards.write_shards(odd_docs, queries.byte_bpe(), shard_bytes=20_000)
    rows = sorted(token_shards.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    docs = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda d: (
        d.doc_id is not None, d.doc_id or 0, d.text is not None, d.text or ""))
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert [r.ids for r in rows] == [library.encode(d.text or "", add_special_tokens=False).ids + [0] for d in docs]
    assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:i]) for i in range(len(rows))]
    assert sorted(r.doc_id or -1 for r in token_shards.lookup(spark, path, [4, None, 77]).collect()) == [-1, -1, 4, 4, 4]
    empty = token_shards.write_shards(no_docs, queries.byte_bpe())
    assert token_shards.read_documents(spark, empty).count() == 0


@pytest.fixture
def ranges_as_asked(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op1_one_key_spans_ranges_and_shards(spark, library, ranges_as_asked):
    docs = [(5, f"text {i} of one key " * 40) for i in range(200)] + [(None, f"no key {i}") for i in range(200)] + [(1, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path = token_shards.write_shards(df, queries.byte_bpe(), shard_bytes=20_000)
    shards = spark.read.parquet(path).collect()
    assert len({s.part for s in shards if 5 in s["keys"]}) > 1 and len({s.part for s in shards if None in s["keys"]}) > 1
    assert all(len(s.payload) <= 20_000 for s in shards)
    rows = token_shards.read_documents(spark, path, with_ids=True).collect()
    want = [(k or 0, library.encode(t, add_special_tokens=False).ids + [0]) for k, t in docs]
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted(want)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or 0 for r in rows] == sorted(k for k, _ in want)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    assert token_shards.lookup(spark, path, [5]).count() == 200 and token_shards.lookup(spark, path, [None]).count() == 200


def test_index_is_minimal_and_perfect():
    keys = [str(i).encode() for i in range(5000)]
    seeds, slots = token_shards.build_index(keys)
    assert sorted(slots) == list(range(5000))
    table = np.zeros(5000, token_shards.SLOT)
    for k, s in zip(keys, slots, strict=True):
        table[s]["fingerprint"] = token_shards.hashed(k, 1 << 32) >> 32
    assert all(token_shards.find_slot(seeds, table, k) == s for k, s in zip(keys, slots, strict=True))
    assert sum(token_shards.find_slot(seeds, table, b"x%d" % i) >= 0 for i in range(5000)) == 0
