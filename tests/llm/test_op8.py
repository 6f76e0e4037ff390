import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm.packing import Encoder, differencing, op8_packing, pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(docs, rows, tok, capacity=2048):
    """Pieces cover every document's ids once; sequences are gapless."""
    want = {}
    for i, text in docs:
        want[i] = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(len(x) for x in want.values())


def test_whole_table(spark, tok):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    padding, total = check(docs, op8_packing(spark, SF).collect(), tok)
    assert padding < 0.02 * total


def test_odd_rows(spark, tok):
    texts = [None, "", " ", "a  b", "a \n b ", " x", "tab\t x", "it's 'll", "<|endoftext|> 12 3", "é ü" * 5000, "z" * 30000, "a b"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, length int")
    check(docs, pack(df).collect(), tok)
    assert pack(df.limit(0)).count() == 0
    twice = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.length) for r in twice.collect())[0][0] == 0 and sum(r.length for r in twice.collect()) == 3 + 3 + 2


def test_both_patterns_give_the_tokenizers_ids(tok):
    e = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in ["one two  three", "x, y.\nZ w", "a 's b", "1 22 333", "ß ñ é\t q", " lead", "trail ", "a\u00a0b \u2028c", "a\x1cb c", "..., ,\n."]:
        assert e(t) == np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_differencing_is_near_equal():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 257, 900).tolist()
    fill = np.bincount(differencing(sizes, 50), weights=sizes, minlength=50)
    assert fill.sum() == sum(sizes) and fill.max() - fill.min() <= 8
    assert differencing([5], 1).tolist() == [0]


def test_added_token_as_the_tokenizer_by_default(spark, tmp_path):
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x  ", "a  <|endoftext|>\n\nb c", "<|endoftext|", "plain text", "", None]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert default.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    check(docs, op8_packing(spark, str(tmp_path)).collect(), default)
