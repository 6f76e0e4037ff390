import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemill.llm.byte_bpe import Encoder, Splitter, Vocabulary, decode, encode, op12_byte_bpe, replay, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def theirs():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_table(spark, theirs):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        ids = theirs.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def whole(parts):
    return [x for ids, sizes in parts for x in lists(ids, sizes)]


def lists(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


ODD = [None, "", " ", "  ", "a  b", " a", "a ", "a \n b", "\n\n x", "x\t y", "it's 'll 'S", "<|endoftext|> 12 3", "é ü" * 50, "z" * 3000, "ab" * 999, "a\x1cb c", "a \x1c b", "a b  c", "՘ ࢏1 a՘b", "日本語 テキスト 12٣", "🎉🎉 x\U0001f9d1‍", "'s't", "a 's b", "\x00 \x00", "of the of the of", "　x 　", "x\r\n y"]


def test_odd_rows(spark, theirs):
    docs = [*enumerate(ODD), (1, "twice"), (None, "no id"), (99, "word " * 200_000)]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in docs], "doc_id long, text string, ids array<int>, bytes string").repartition(3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, bytes(r.bytes), r.ids) for r in decode(encode(df)).collect()))
    want = sorted((i is not None, i or 0, (t or "").encode(), theirs.encode_ordinary(t or "")) for i, t in docs)
    assert got == want
    assert decode(encode(df.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.bytes) for r in decode(null).orderBy("doc_id").collect()] == [(1, None), (2, bytearray())]
    with pytest.raises(Exception):
        decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_every_class_of_characters_as_the_library(theirs):
    r = random.Random(5)
    chars = [chr(c) for c in [*range(0x250), *range(0x500, 0x600), *range(0x2000, 0x20A0), *r.sample([c for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000], 3000)]]
    texts = [f"a{c}b 1{c}2 {c} !{c}?" for c in chars]
    e = Encoder(vocabulary(None), public_tokenizers.PATTERN)
    assert whole(e(texts)) == [theirs.encode_ordinary(t) for t in texts]
    s = Splitter(public_tokenizers.PATTERN)
    s.check(set(chars))
    assert "".join(s("".join(chars))) == "".join(chars)


def test_texts_with_every_gap(theirs):
    e = Encoder(vocabulary(None), public_tokenizers.PATTERN)
    texts = [f"a{c}b c d,{c}e .{c} x" for c in Splitter.GAPS] + ["x y" + Splitter.GAPS + "z's w"]
    assert whole(e(texts)) == [theirs.encode_ordinary(t) for t in texts]
    assert whole(e([f"a{Splitter.GAPS}b"])) == [theirs.encode_ordinary(f"a{Splitter.GAPS}b")]


@pytest.mark.parametrize("seed", range(40))
def test_any_vocabulary_in_any_order(seed):
    """Vocabularies whose ranks do not rise with what tokens are made of, so
    that merges make pairs of lower ranks and equal tokens come of several."""
    r = random.Random(seed)
    tokens = list({"".join(r.choices("abc", k=r.randint(2, 6))) for _ in range(60)})
    r.shuffle(tokens)
    ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    theirs = tiktoken.Encoding("own", pat_str=r"[abc]+|\s", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(r.choices("abc", weights=[5, 2, 1], k=n)) for n in [*[1, 2, 3] * 5, *range(2, 60), 150, 800]]
    v = Vocabulary(ranks)
    got = lists(*replay([w.encode() for w in words], v))
    for w, ids in zip(words, got, strict=True):
        assert (ids if w.encode() not in ranks else [ranks[w.encode()]]) == theirs.encode_ordinary(w), w


def test_memory_is_given_up_between_blocks(monkeypatch, theirs):
    from pagemill.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "MEMORY", 10)
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    e = Encoder(vocabulary(None), public_tokenizers.PATTERN)
    for _ in range(3):
        texts = ["Some wordsplits unheardof", "more  of thesequences xyzzyx"]
        assert whole(e(texts)) == [theirs.encode_ordinary(t) for t in texts]
        assert len(e.words) < 20
