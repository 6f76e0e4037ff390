"""Byte-level BPE: merges replayed over all distinct words of a block at once,
from an inverted index of token pairs, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shelf import table

#: Characters of texts whose words are replayed together (a longer text alone),
#: and of those whose ids are given at once.
BLOCK, SLICE = 8 << 20, 1 << 20
#: Words, and stretches between spaces, that a worker remembers between blocks.
MEMORY = 600_000
END, GONE = -1, -2


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


class Vocabulary:
    """Tokens and their ids, which are also the ranks of the merges, and every
    pair of tokens that makes one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids, size = ranks, max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.size, self.known = size, np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.text = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = sorted((x * size + y, r) for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None)
        self.pairs, self.makes = np.array([*(k for k, _ in pairs), np.iinfo(np.int64).max]), np.array([*(r for _, r in pairs), -1], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = self.merged(self.single[:, None], self.single[None, :]).astype(np.int32)

    def merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The tokens that x and y make, -1 where none or where either is no
        token."""
        key = np.multiply(x, self.size, dtype=np.int64) + y
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (x >= 0) & (y >= 0), self.makes[at], -1)


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, how many each has), no word being empty.

    The words lie end to end, END behind each. An index has for every token
    that a pair of neighbours makes the places of such pairs in all words. Its
    merges are applied in rank order, each at all its places, and only the
    pairs of these places' neighbours are entered anew; what is entered is
    never looked for again. Of places that overlap the left one is taken, as
    in a replay of that word alone. Where a merge makes a pair of a lower rank,
    which such a replay takes before it goes on, the word's other places wait.
    """
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes) - 1
    tok = v.single[flat]
    tok[ends] = END
    n = len(tok)
    after, before, word = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray, makes: np.ndarray) -> None:
        order = np.argsort(makes, kind="stable")
        places, makes = places[order], makes[order]
        cuts = np.flatnonzero(makes[1:] != makes[:-1]) + 1
        at = 0
        for to in [*cuts.tolist(), len(makes)]:
            r = int(makes[at])
            if r in index:
                index[r].append(places[at:to])
            else:
                index[r] = [places[at:to]]
                heapq.heappush(heap, r)
            at = to

    made = v.first[flat[:-1], flat[1:]]
    made[ends[:-1]] = -1
    made[ends - 1] = -1  # a word's last byte has no neighbour
    places = np.flatnonzero(made >= 0).astype(np.int32)
    if len(places):
        enter(places, made[places])
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        p = np.sort(np.concatenate(parts) if len(parts) > 1 else parts[0])
        if len(p) > 1:
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        q = after[p]
        x, y = tok[p], tok[q]
        # tokens only grow: where the two still span r's bytes they still make r
        still = (x >= 0) & (y >= 0)
        still &= v.lengths[x] + v.lengths[y] == v.lengths[r]
        p, q = p[still], q[still]
        if not len(p):
            continue
        if len(p) > 1:
            every = p
            chained = np.concatenate([[False], q[:-1] == p[1:]])
            if chained.any():
                i = np.arange(len(p))
                take = (i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0
                p, q = p[take], q[take]
            # what a merge makes while those to the right of it are still to come
            left, right = v.merged(tok[before[p]], np.int64(r)), v.merged(np.int64(r), tok[after[q]])
            twice = np.concatenate([[False], after[q[:-1]] == p[1:]])
            lower = ((left >= 0) & (left < r)) | ((right >= 0) & (right < r))
            if twice.any() and 0 <= (m := int(v.merged(np.int64(r), np.int64(r)))) < r:
                lower |= twice
            if lower.any():
                waits = np.isin(word[p], word[p][lower])
                first = np.concatenate([[True], word[p][1:] != word[p][:-1]])
                late = every[np.isin(word[every], word[p][waits]) & ~np.isin(every, p[first])]
                if len(late):
                    enter(late, np.full(len(late), r))
                p, q = p[~waits | first], q[~waits | first]
        tok[p], tok[q] = r, GONE
        right = after[q]
        after[p] = right
        before[right] = p
        left = before[p]
        places, makes = np.concatenate([left, p]), np.concatenate([v.merged(tok[left], tok[p]), v.merged(tok[p], tok[right])])
        new = makes >= 0
        if new.any():
            enter(places[new], makes[new])
    tok = tok[tok != GONE]
    ends = np.flatnonzero(tok == END)
    return tok[tok != END], np.diff(np.concatenate([[-1], ends])) - 1


class Splitter:
    """Matches of the vocabulary's pattern, with its library's classes of
    characters: those whose class differs here, as newer tables have it, are
    masked by one of the right class while the pattern is matched."""

    #: One character of each class: letter, number, other, white space.
    MASKS = "\u0436\u0663\u00a7\u2003"
    #: White space that texts rarely have.
    GAPS = "\x0b\x0c\x85\u2028\u2029\u3000\u2003"

    def __init__(self, pattern: str):
        import regex

        self.source, self.pattern = pattern, regex.compile(pattern)
        self.classes = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]
        self.checked = {chr(i) for i in range(128)}
        self.odd: dict[int, str] = {}

    def check(self, chars: set[str]) -> None:
        new = sorted(chars - self.checked)
        if not new:
            return
        import tiktoken

        # a match that is a token as a whole is one id: it shows the class
        ranks = {bytes([i]): i for i in range(256)}
        for i, c in enumerate(new):
            ranks |= {p + c.encode(): 256 + 3 * i + j for j, p in enumerate((b"a", b"1", b"!"))}
        bpe = tiktoken.Encoding("classes", pat_str=self.source, mergeable_ranks=ranks, special_tokens={})
        for c in new:
            theirs = next((k for k, p in enumerate("a1!") if len(bpe.encode_ordinary(p + c)) == 1), 3)
            if not self.classes[theirs].match(c):
                self.odd[ord(c)] = self.MASKS[theirs]
        self.checked.update(new)

    def __call__(self, text: str) -> list[str]:
        if self.odd and not text.isascii() and any(ord(c) in self.odd for c in set(text)):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]
        return self.pattern.findall(text)

    def gap(self, chars: set[str]) -> str | None:
        """A white space that is not among chars."""
        return next((c for c in self.GAPS if c not in chars), None)


def numbering() -> defaultdict:
    """Numbers keys from 0 as they are first asked for."""
    return defaultdict(count().__next__)


class Ids:
    """Lists of ids by number, end to end in one pool."""

    def __init__(self):
        self.pool, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.pool[ranges(self.begins[numbers], self.sizes[numbers])]

    def sums(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many ids the first counts[0] numbers have, the next, and so on."""
        total = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


class Encoder:
    """Ids of texts, a block at a time.

    A text whose spaces are single and stand between other than white space is
    parted there first: no match of the pattern crosses such a space but that
    it may begin with it, so what stands between has the same matches
    everywhere. Each different stretch is split by the pattern once, and each
    different match goes into the block's replay once. A match that is a token
    is its id alone. Both are numbered as they come, and texts are lists of
    numbers from then on.
    """

    def __init__(self, v: Vocabulary, pattern: str):
        self.v, self.split = v, Splitter(pattern)
        self._forget()

    def _forget(self) -> None:
        # a stretch at the beginning of a text is a tuple of itself, any other follows a space
        self.words, self.stretches = numbering(), numbering()
        self.word_ids, self.stretch_ids = Ids(), Ids()
        self.odd = np.zeros(0, bool)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new ones are encoded."""
        got = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        raw = [w.encode() for w in islice(self.words, len(self.word_ids.sizes), None)]
        whole = np.array([self.v.ids.get(w, -1) for w in raw], np.int32)
        sizes = np.ones(len(raw), np.int64)
        rest = np.flatnonzero(whole < 0)
        ids = whole
        if len(rest):
            made, sizes[rest] = replay([raw[i] for i in rest.tolist()], self.v)
            begins = np.cumsum(sizes) - sizes
            ids = np.zeros(sizes.sum(), np.int32)
            ids[begins[whole >= 0]] = whole[whole >= 0]
            ids[ranges(begins[rest], sizes[rest])] = made
        self.word_ids.add(ids, sizes)
        return got

    def _learn(self) -> None:
        """Encodes the stretches that have no ids yet. One that begins or ends
        with white space, or is empty, is odd: its text is split as a whole."""
        new = list(islice(self.stretches, len(self.odd), None))
        bare = [x if isinstance(x, str) else x[0] for x in new]
        odd = np.array([not x or x[0].isspace() or x[-1].isspace() for x in bare], bool)
        plain = [" " + x if isinstance(x, str) else x[0] for x, o in zip(new, odd.tolist(), strict=True) if not o]
        chars = set().union(*map(set, bare))
        self.split.check(chars)
        gap = self.split.gap(chars)
        if gap is None:
            parts = [self.split(x) for x in plain]
            counts, numbers = np.array([len(x) for x in parts], np.int64), self._numbers(list(chain.from_iterable(parts)))
        else:  # all in one text, with a white space between them that none of them has
            numbers = self._numbers(self.split(gap.join(plain)) if plain else [])
            at = np.concatenate([[-1], np.flatnonzero(numbers == self.words.get(gap, -1)), [len(numbers)]])
            counts = np.diff(at)[: len(plain)] - 1
            numbers = numbers[numbers != self.words.get(gap, -1)]
        sizes = np.zeros(len(new), np.int64)
        sizes[~odd] = self.word_ids.sums(numbers, counts)
        self.stretch_ids.add(self.word_ids.of(numbers), sizes)
        self.odd = np.concatenate([self.odd, odd])

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts end to end, how many each has), in order."""
        if len(self.words) + len(self.stretches) > MEMORY:
            self._forget()
        lists = []
        for t in texts:
            p: list = t.split(" ")
            p[0] = (p[0],)
            lists.append(np.fromiter(map(self.stretches.__getitem__, p), np.int32, len(p)))
        self._learn()
        odd = [i for i, x in enumerate(lists) if self.odd[x].any()]
        if odd:
            parts = [self.split(texts[i]) for i in odd]
            counts, numbers = np.array([len(x) for x in parts], np.int64), self._numbers(list(chain.from_iterable(parts)))
            whole = dict(zip(odd, np.split(numbers, np.cumsum(counts)[:-1]), strict=True))
        else:
            whole = {}
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE) and (to in whole) == (at in whole):
                size += len(texts[to])
                to += 1
            source = self.word_ids if at in whole else self.stretch_ids
            some = [whole[i] for i in range(at, to)] if at in whole else lists[at:to]
            numbers = np.concatenate(some)
            yield source.of(numbers), source.sums(numbers, np.array([len(x) for x in some]))
            at = to


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[str | None, Encoder] = {}


def vocabulary(path: str | None) -> Vocabulary:
    """Of a file of ranks, the public 50k one by default; a worker keeps it."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _VOCABULARIES:
        with open(path, "rb") as f:
            _VOCABULARIES[path] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _VOCABULARIES[path]


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of each row: its text's token ids, without
    special tokens. Tasks replay the merges over blocks of BLOCK characters, so
    nothing is shuffled; how texts are dealt to blocks changes no id.

    Null and empty texts have no ids; special tokens' text is plain text; null
    ids and repeated rows are kept; other columns are left out, whatever they
    are named; an empty table gives no row. A text is encoded whole, however
    long it or a word of it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if ranks_path not in _ENCODERS:  # a worker keeps it, and what it knows, for its next tasks
            _ENCODERS[ranks_path] = Encoder(vocabulary(ranks_path), public_tokenizers.PATTERN)
        for b in batches:
            texts, size, at = [], 0, 0
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > BLOCK or i + 1 == b.num_rows:
                    for ids, sizes in _ENCODERS[ranks_path](texts):
                        offsets = np.concatenate([[0], np.cumsum(sizes)])
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])
                        at += len(sizes)
                    texts, size = [], 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(coded: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """coded's (id_col, ids) with the bytes that the ids stand for. No ids are
    no bytes, null ones null; an id that the vocabulary lacks, or a null among
    them, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path)
        for b in batches:
            out, size, at = [], 0, 0
            for i, ids in enumerate(b.column(1)):
                if ids.is_valid:
                    x = ids.values.to_numpy().astype(np.int64)
                    if len(x) and not (x.min() >= 0 and x.max() < v.size and v.known[x].all()):
                        raise ValueError("ids that the vocabulary lacks")
                    out.append(v.text[ranges(v.begins[x], v.lengths[x])].tobytes())
                    size += len(out[-1])
                else:
                    out.append(None)
                if size > SLICE or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(out)) for c in b.columns), pa.array(out, pa.binary())], names=["id", "ids", "bytes"])
                    out, size, at = [], 0, i + 1

    return coded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {dict(coded.dtypes)[id_col]}, ids array<int>, bytes binary").select(F.col("id").alias(id_col), "ids", "bytes")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
#: Replaying merges has no SQL form.
ORACLE: dict[str, str] = {}
