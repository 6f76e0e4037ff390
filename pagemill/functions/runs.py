"""Terms of texts and their counts, by Arrow batches over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import RETRIEVAL_STOPWORDS, tokenize

#: Bytes of text that are worked on at once; a longer text is taken alone.
BYTES = 4 << 20
_IN_RUN = np.zeros(256, bool)
_IN_RUN[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts (none null) of about
    BYTES in all; offsets are those within bytes."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BYTES, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs of a-z and 0-9 of two or more bytes, as often as they occur:
    which text each is of, and the run. No run goes from one text to the next."""
    inside = _IN_RUN[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    ends[first[first > 0] - 1] = inside[first[first > 0] - 1]
    begins, sizes = np.flatnonzero(begins), np.flatnonzero(ends)
    sizes = sizes + 1 - begins
    inside[begins[sizes == 1]] = False
    begins, sizes = begins[sizes > 1], sizes[sizes > 1]
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return np.searchsorted(offsets, begins, "right") - 1, found


_IN_WORD = _IN_RUN.copy()
_IN_WORD[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_", np.uint8)] = True


def words_and_others(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs of letters a-z, digits and _ of any case, and every other
    character alone: which text each is of, and what it is."""
    inside = _IN_WORD[data]
    begins = ~inside & ((data & 0xC0) != 0x80)
    begins[1:] |= inside[1:] & ~inside[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(begins)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return np.searchsorted(offsets, begins, "right") - 1, found


def packed_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, ids): of some texts, those that have a token of
    words_and_others(), each once; a token has a row for each lot of texts."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(1)):
                of, found = words_and_others(data, offsets)
                coded = found.dictionary_encode()
                code, of = np.divmod(np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (hi - lo) + of), hi - lo)
                at = np.searchsorted(code, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(at), b.column(0).take(pa.array(of + lo)))], names=["token", "ids"])

    return texts.select(id_col, F.coalesce(text_col, F.lit("")).alias("_said")).mapInArrow(run, f"token string, ids array<{kind}>")


_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What words_and_others() finds, and each two and three runs that follow one
    another, whatever stands between them: which text each is of, its 64-bit
    hash, and how many runs it has, 0 if it is another character."""
    of, found = words_and_others(data, offsets)
    at = np.frombuffer(found.buffers()[1], np.int32)
    begins, sizes = at[:-1], np.diff(at)
    if not len(begins):
        return of, np.zeros(0, np.uint64), np.zeros(0, np.int8)
    powers = np.full(sizes.max(), _FACTOR).cumprod()
    one = _spread(np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(begins, sizes)], begins))
    is_run = _IN_WORD[data[begins]]
    run, text = one[is_run], of[is_run]
    two = _spread(run[:-1] * _FACTOR + run[1:])
    three = _spread(two[:-1] * _FACTOR + run[2:])
    in_two, in_three = text[:-1] == text[1:], text[:-2] == text[2:]
    keys = [one, two[in_two], three[in_three]]
    n = np.concatenate([is_run.astype(np.int8), np.full(len(keys[1]), 2, np.int8), np.full(len(keys[2]), 3, np.int8)])
    return np.concatenate([of, text[:-1][in_two], text[:-2][in_three]]), np.concatenate(keys), n


def _by_key(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by key, then text, each pair once."""
    order = np.lexsort((of, key))
    of, key = of[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return of[fresh], key[fresh]


def packed_windows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, ids): of some texts, those that have a window of that hash, each
    once; a key has a row for each lot of texts."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offsets in pieces(b.column(1)):
                of, key = _by_key(*windows(data, offsets)[:2])
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
                at = pa.array(np.append(first, len(key)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.ListArray.from_arrays(at, b.column(0).take(pa.array(of + lo)))], names=["key", "ids"])

    return texts.select(id_col, F.coalesce(text_col, F.lit("")).alias("_said")).mapInArrow(run, f"key long, ids array<{kind}>")


def widest_windows(phrases: DataFrame, column: str) -> DataFrame:
    """(phrase, key): the hashes of a phrase's widest windows, each once: of all
    its runs, up to three; of its characters if it has no run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(0)):
                of, key, n = windows(data, offsets)
                widest = np.minimum(np.bincount(of[n == 1], minlength=hi - lo), 3)[of] == n
                of, key = _by_key(of[widest], key[widest])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + lo)), pa.array(key.view(np.int64))], names=["phrase", "key"])

    return phrases.select(F.coalesce(column, F.lit("")).alias("phrase")).mapInArrow(run, "phrase string, key long")


def _asked(docs: DataFrame, text_col: str, tokenizer) -> Column:
    """What the counting functions take of a text: its lower case, or the terms
    that another tokenizer gives."""
    return F.lower(F.coalesce(text_col, F.lit(""))) if tokenizer is tokenize else tokenizer(F.col(text_col))


def _counted(texts: pa.Array, stop: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(first, last, text, code, tf, dl, words) of consecutive texts: code is a
    term's place in words; text counts from first. Texts are strings, or lists
    of terms."""
    if pa.types.is_list(texts.type):
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
        all_ = [(0, len(texts), np.repeat(np.arange(len(texts)), sizes), texts.flatten())]
    else:
        all_ = ((lo, hi, *runs(data, offsets)) for lo, hi, data, offsets in pieces(texts))
    for lo, hi, of, found in all_:
        coded = found.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if stop is not None and len(words):
            kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[code]
            of, code = of[kept], code[kept]
        dl = np.bincount(of, minlength=hi - lo)
        pairs, tf = np.unique(code * (hi - lo) + of, return_counts=True)  # by term, then text
        code, of = np.divmod(pairs, hi - lo)
        yield lo, hi, of, code, tf, dl[of], words


def _stop(tokenizer) -> pa.Array | None:
    return pa.array(RETRIEVAL_STOPWORDS) if tokenizer is tokenize else None


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize) -> DataFrame:
    """(doc_id, term, tf, dl) of each row's terms: how often it has each, and
    how many it has in all. Rows that share an id are counted apart."""
    kind, stop = dict(docs.dtypes)[id_col], _stop(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, of, code, tf, dl, words in _counted(b.column(1), stop):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + lo)), words.take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(dl.astype(np.int64))], names=["doc_id", "term", "tf", "dl"])

    return docs.select(F.col(id_col).alias("doc_id"), _asked(docs, text_col, tokenizer).alias("said")).mapInArrow(run, f"doc_id {kind}, term string, tf long, dl long")


def packed_counts(docs: DataFrame, place: Column, hot: dict[str, int], id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize) -> DataFrame:
    """term_counts() with a row for each term of some texts: (term, part, places,
    ids, tfs, dls), lists of what the texts have of it. part is 0, or of a term
    of hot, the first so many bits of the text's place."""
    kind, stop = dict(docs.dtypes)[id_col], _stop(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_places = b.column(1).to_numpy()
            for lo, _, of, code, tf, dl, words in _counted(b.column(2), stop):
                places, part = all_places[of + lo], np.zeros(len(of), np.int64)
                bits = np.array([hot.get(w, 0) for w in words.to_pylist()], np.uint64)[code] if hot and len(words) else np.zeros(0, np.uint64)
                if bits.any():
                    at = np.flatnonzero(bits)
                    part[at] = (places[at].view(np.uint64) >> (np.uint64(64) - bits[at])).astype(np.int64)
                    order = np.lexsort((part, code))
                    of, code, tf, dl, places, part = (x[order] for x in (of, code, tf, dl, places, part))
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
                at = pa.array(np.append(first, len(code)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(places), b.column(0).take(pa.array(of + lo)), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code[first])), pa.array(part[first]), *lists], names=["term", "part", "places", "ids", "tfs", "dls"])

    rows = docs.select(F.col(id_col).alias("doc_id"), place.alias("place"), _asked(docs, text_col, tokenizer).alias("said"))
    return rows.mapInArrow(run, f"term string, part long, places array<long>, ids array<{kind}>, tfs array<int>, dls array<int>")
