"""Packing of tokenised documents into sequences by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.mixing import in_mixed_order
from pagemill.llm.shelf import table

END_ID = 1
#: The vocabulary's added token and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """Karmarkar-Karp in k ways, balanced: which of k windows each item goes to.

    Items in falling order, k at a time, make partial partitions of one item a
    window. The two partitions of largest spread are merged, the heaviest
    windows of one with the lightest of the other, until one is left.
    """
    order = np.argsort(-np.asarray(sizes), kind="stable")
    leaves = -(-len(sizes) // k)
    sums: list = []
    parts: list = [None] * leaves
    for i in range(leaves):
        v = np.zeros(k, np.int64)
        own = np.asarray(sizes)[order[i * k : (i + 1) * k]]
        v[: len(own)] = own
        sums.append(v)
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        rank = np.argsort(-total, kind="stable")
        parts.append((a, b, rank))
        sums.append(total[rank])
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(parts) - 1))
    window = np.zeros(len(sizes), np.int64)
    maps = {len(parts) - 1: np.arange(k)}
    for node in range(len(parts) - 1, -1, -1):
        m = maps.pop(node)
        if node < leaves:
            own = order[node * k : (node + 1) * k]
            window[own] = m[: len(own)]
        else:
            a, b, rank = parts[node]
            maps[a], maps[b] = np.empty(k, np.int64), np.empty(k, np.int64)
            maps[a][rank] = m
            maps[b][k - 1 - rank] = m
    return window


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, the end id last.

    The vocabulary's split pattern looks ahead only where white space follows
    white space or ends the text; a text whose white space is single spaces and
    line feeds between words is split by the same pattern without the
    lookahead, which runs faster.

    With `added`, the added token's text is its id, and what stands between is
    encoded on its own, as tokenizers does by default; else it is plain text.
    """

    LOOKAHEAD = r"|\s+(?!\S)"

    def __init__(self, ranks_path: str, added: bool = False):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = public_tokenizers.PATTERN
        make = lambda p: tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.full, self.plain = make(full), make(full.replace(self.LOOKAHEAD, ""))
        self.end, self.between = END_ID.to_bytes(4, "little"), ADDED_ID.to_bytes(4, "little")
        self.added = added

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.added and ADDED in text:
            return self.between.join(map(self._ids, text.split(ADDED))) + self.end
        return self._ids(text) + self.end

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        single = len(words) == gaps + 1 and len("".join(words)) + gaps == len(text)
        bpe = self.plain if single else self.full
        return bytes(bpe.encode_to_tiktoken_buffer(text, set()))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Packer:
    """Gathers documents into groups of `windows` windows and packs each group.

    Whole windows of a document are sequences of their own. What is left is cut
    into pieces of at most max_piece ids; a group closes when its pieces fill
    its windows but for `slack` ids a window (the last document is cut there).
    """

    def __init__(self, capacity: int, windows: int, max_piece: int, slack: int, first_sequence: int):
        self.capacity, self.windows, self.max_piece, self.room = capacity, windows, max_piece, windows * (capacity - slack)
        self.sequence, self.group, self.size, self.rows = first_sequence, [], 0, []

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self._row((doc, at, ids[4 * at : 4 * (at + self.capacity)], total), self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        while at < total:
            n = min(self.max_piece, total - at, self.room - self.size)
            self.group.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.size += n
            at += n
            if self.size == self.room:
                self._pack(self.group)
                self.group, self.size = [], 0

    def _pack(self, pieces: list[tuple]) -> None:
        sizes = [len(p[2]) // 4 for p in pieces]
        k = -(-sum(sizes) // self.capacity)
        while True:
            window = differencing(sizes, k)
            fill = np.bincount(window, weights=sizes, minlength=k)
            if fill.max() <= self.capacity:
                break
            k += 1
        offset = [0] * k
        for p, w, s in zip(pieces, window.tolist(), sizes, strict=True):
            self._row(p, self.sequence + w, offset[w])
            offset[w] += s
        self.sequence += k

    def finish(self) -> None:
        """The rest: whole windows are packed alike, the remaining ids go into
        unpadded sequences whose lengths are falling powers of two."""
        whole = self.size - self.size % self.capacity
        main, tail, at = [], [], 0
        for doc, start, ids, total in self.group:
            n = len(ids) // 4
            cut = min(max(whole - at, 0), n)
            if cut:
                main.append((doc, start, ids[: 4 * cut], total))
            if cut < n:
                tail.append((doc, start + cut, ids[4 * cut :], total))
            at += n
        if main:
            self._pack(main)
        left = sum(len(p[2]) // 4 for p in tail)
        length, offset = 1 << left.bit_length() >> 1, 0
        for doc, start, ids, total in tail:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(n - at, length - offset)
                self._row((doc, start + at, ids[4 * at : 4 * (at + take)], total), self.sequence, offset)
                at, offset, left = at + take, offset + take, left - take
                if offset == length:
                    self.sequence += 1
                    length, offset = 1 << left.bit_length() >> 1, 0
        self.group, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COLUMNS), names=COLUMNS)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    capacity: int = 2048,
    windows: int = 128,
    max_piece: int = 256,
    slack: int = 4,
    added: bool = False,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset (see Packer).

    Each input partition is tokenised and packed in one streaming pass without
    a shuffle, one group in memory at a time; sequence ids carry the partition
    number, so a task that runs again gives the same rows. The sequences that
    aren't full are padded by the reader to `capacity`, but for those whose
    length is a power of two.

    Null and empty texts are the end id alone; null ids stay null; rows that
    share an id are packed as often as they occur; other columns are ignored;
    an empty table gives no row. `added`: see Encoder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        if (path, added) not in _ENCODERS:  # a worker keeps it for its next tasks
            _ENCODERS[path, added] = Encoder(path, added)
        encode = _ENCODERS[path, added]
        packer = Packer(capacity, windows, max_piece, slack, TaskContext.get().partitionId() << 32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py()))
            if len(packer.rows) > 20_000:
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of docs in the order of the mixture, which is taken anew
    from the documents: files are dealt to partitions in no order of theirs.
    Null texts are the end id alone, null ids stay null, repeated rows are
    packed each, other columns are left out whatever they are named."""
    return pack(in_mixed_order(spark, docs, sf_dir), added=True)


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
