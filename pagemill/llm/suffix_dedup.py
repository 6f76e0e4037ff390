"""Exact-substring deduplication with a logarithmic family of sparse suffix
arrays: suffixes that begin at content-chosen anchors, sorted by what they
begin with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.minhash_dedup import pieces
from pagemill.llm.shelf import drop, put, table
from pagemill.llm.shingles import BASE, BASE_INV, SPACE, U, mix, powers, word_prints

#: Bytes (or symbols) handled at once, few enough for a processor's cache;
#: batches of a corpus; windows of a block at each refinement.
CHUNK, BATCHES, STEPS = 131_072, 4, (20, 1)


@dataclass(frozen=True)
class Unit:
    """What windows are made of: kind 0 bytes, 1 words; symbols of a window,
    of an anchor."""

    kind: int
    length: int
    anchor: int


def symbols(text: bytes, kind: int) -> np.ndarray:
    """The bytes of a text, or fingerprints of its words (A-Z lower-cased), the
    words of about CHUNK bytes at a time."""
    if not kind:
        return np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        out.append(word_prints([text[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def all_symbols(texts: list[bytes], kind: int) -> list[np.ndarray]:
    if not kind or len(texts) == 1:
        return [symbols(t, kind) for t in texts]
    words, counts = word_prints(texts)
    return np.split(words, np.cumsum(counts)[:-1])


def _sums(s: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s) + 1, U)
    np.cumsum((s.astype(U) + U(1)) * powers(len(s), BASE, "up"), out=out[1:])
    return out


def _prints(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n bytes from each position."""
    return mix((sums[at + n] - sums[at]) * powers(len(sums), BASE_INV, "down")[at])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima of blocks from both ends."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    ahead = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(parts: list[np.ndarray], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For every part of at least `length` symbols its anchors: (part, position,
    first and last window start that it stands for, fingerprint).

    The anchor of a window of `length` symbols is its string of `anchor`
    symbols of least fingerprint, the leftmost of such: what it is depends on
    the window alone, so equal windows have equal anchors at equal offsets.
    """
    size = np.array([len(p) for p in parts], np.int64)
    if size.max(initial=0) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U),)
    flat = np.concatenate(parts)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), size)
    print_at = _prints(_sums(flat), np.arange(len(flat) - anchor + 1), anchor)
    low = U((1 << 24) - 1)
    least = sliding_min((print_at & ~low) | np.arange(len(print_at), dtype=U), length - anchor + 1)
    at = (least & low).astype(np.int64)
    inside = owner[: len(flat) - length + 1] == owner[length - 1 :]
    window = np.flatnonzero(inside)
    at = at[window]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1) | (np.diff(owner[window], prepend=-1) != 0))
    last = np.append(first[1:], len(window)) - 1
    who = owner[window[first]]
    return who, at[first] - begin[who], window[first] - begin[who], window[last] - begin[who], print_at[at[first]]


def segments(texts: list[np.ndarray], length: int, chunk: int | None = None) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (text, offset, symbols) of about chunk symbols; a longer text
    comes in overlapping parts that hold each of its windows once."""
    chunk = chunk or CHUNK
    group, size = [], 0
    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - length + 1), chunk):
            part = t[off : off + chunk + length - 1]
            if group and size + len(part) > chunk + length:
                yield group
                group, size = [], 0
            group.append((i, off, part))
            size += len(part)
    if group:
        yield group


class Family:
    """A logarithmic family of suffix arrays, kept as tables in the shared
    folder. A suffix is one that begins at an anchor; a level holds the heads
    (the anchors' fingerprints) of its suffixes in order, equal ones as one row
    with the least and greatest place, so no head is hot.

    add() makes a batch's array, merge-scans it against every level for heads
    that stand at two places, and then merges levels of as many batches: there
    are logarithmically many, and each suffix is rewritten as many times."""

    KEY = ["core", "more"]

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def _array(self, rows: DataFrame) -> DataFrame:
        return put(rows.groupBy(*self.KEY).agg(F.min("a").alias("a"), F.max("b").alias("b")).sortWithinPartitions(*self.KEY), "level")

    def add(self, suffixes: DataFrame) -> None:
        """suffixes: (core, more, who), core and more being the head."""
        new = self._array(suffixes.select(*self.KEY, F.col("who").alias("a"), F.col("who").alias("b")))
        met = new.where("a <> b").select(*self.KEY)
        for _, level in self.levels:
            old = level.select(*self.KEY, F.col("a").alias("c"), F.col("b").alias("d"))
            met = met.unionByName(new.join(old, self.KEY).where("least(a, c) <> greatest(b, d)").select(*self.KEY))
        self.found.append(put(met, "found"))
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, x), (m, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, self._array(x.unionByName(y))))
            drop(x)
            drop(y)

    def matches(self) -> DataFrame:
        """Heads that stand at two places, over all batches added."""
        out = self.found[0]
        for f in self.found[1:]:
            out = out.unionByName(f)
        return put(out.distinct(), "heads")

    def close(self) -> None:
        for t in [*(level for _, level in self.levels), *self.found]:
            drop(t)
        self.levels, self.found = [], []


#: A mark: some neighbouring windows of a text, those that start `back` to
#: `back` - `fwd` symbols before the anchor at `at`. core and more: 128 bits of
#: what they share (of an anchor 64); span and end: of all that they cover; k1
#: and k2: of the text.
MARK = "kind int, core long, more long, span long, end long, k1 long, k2 long, at long, back int, fwd int"
_TYPES = [t.split()[1] for t in MARK.split(", ")]


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [np.full(len(columns[0]), kind), *columns]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, t in zip(arrays, _TYPES, strict=True)], names=[c.split()[0] for c in MARK.split(", ")])


def _digests(view: memoryview, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of view[begin:end], as two numbers, for each."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(view[i:j], s) for i, j, s in zip(begin.tolist(), end.tolist(), seed.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def first_marks(k1: np.ndarray, k2: np.ndarray, texts: list[np.ndarray], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Marks of the texts' anchors."""
    for group in segments(texts, unit.length):
        which, off = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
        who, at, lo, hi, h = anchors([g[2] for g in group], unit.length, unit.anchor)
        if not len(who):
            continue
        flat, size = np.concatenate([g[2] for g in group]), np.array([len(g[2]) for g in group], np.int64)
        start, w = (np.cumsum(size) - size)[who], flat.itemsize
        spans = _digests(memoryview(flat).cast("B"), w * (start + lo), w * (start + hi + unit.length), 2 * (at - lo) + unit.kind)
        yield _batch(unit.kind, h.view(np.int64) ^ np.int64(unit.kind), np.zeros(len(h), np.int64), *spans, k1[which[who]], k2[which[who]], at + off[who], at - lo, hi - lo)


def finer_marks(k1: int, k2: int, text: np.ndarray, at: np.ndarray, back: np.ndarray, fwd: np.ndarray, unit: Unit, step: int) -> pa.RecordBatch:
    """The marks' windows in blocks of `step` neighbours, counted from the
    anchor: core is what all windows of a block share (so equal windows of
    other texts share it), span what those of this mark cover. With step 1
    both are the window."""
    view, w = memoryview(text).cast("B"), text.itemsize
    step = min(step, unit.length - unit.anchor + 1)
    least = (back - fwd) // step
    many = back // step - least + 1
    row = np.repeat(np.arange(len(at)), many)
    b = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - least, many)
    at, far, near = at[row], np.minimum(back[row], (b + 1) * step - 1), np.maximum((back - fwd)[row], b * step)
    core = _digests(view, w * (at - b * step), w * (at - (b + 1) * step + 1 + unit.length), 2 * b + unit.kind)
    span = core if step == 1 else _digests(view, w * (at - far), w * (at - near + unit.length), 2 * far + unit.kind)
    return _batch(unit.kind, *core, *span, np.full(len(row), k1), np.full(len(row), k2), at, far, far - near)


def _who() -> F.Column:
    """The place of a mark. Bytes: a position. Words: a text, as only passages
    that other texts hold count."""
    return F.when(F.col("kind") == 0, F.xxhash64("k1", "k2", "at")).otherwise(F.xxhash64("k1", "k2"))


def _met(marks: DataFrame, *by: str) -> DataFrame:
    """(*by, a, b) of those that stand at two places, a and b the least and
    greatest. Written, so that the joins with it read two plain shuffles, of
    which a skewed one can be split."""
    return put(marks.withColumn("who", _who()).groupBy(*by).agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a <> b"), "met")


def without_repeats(docs: DataFrame, length: int = 400, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words) per
    row: each byte goes that a string of `length` bytes covers which also
    starts elsewhere. n_shared_words counts the words that runs of `words`
    words cover which another row has too (A-Z lower-cased, whatever the white
    space); it removes nothing.

    1. One pass finds every text's anchors (anchors()); an anchor stands for
       neighbouring windows. Batches of the corpus go through a Family of
       suffix arrays, which tells the anchors that stand at two places; the
       others' windows repeat nowhere.
    2. A mark whose whole span stands at two places is covered. The rest, at
       the edges of repeated passages, is refined: blocks of STEPS[0] windows
       whose common part repeats, then single windows. Whatever is refined is
       a small row that is counted with map-side sums, so a passage that very
       many texts share is spread over all tasks, at every size in one way.
    3. Covered ranges are merged per text, and texts are hashed without them.

    All this runs on distinct texts (by 120 bits of their SHA-256); equality of
    spans, blocks and windows is by 128 bits of XXH3 (words by 64 each). A text
    that several rows hold goes whole if it has `length` bytes, and all its
    words are shared if it has `words`. Null texts are empty; null ids and
    repeated rows are texts like others (rows that repeat cover each other);
    extra columns are ignored; shorter texts stay whole.
    """
    units = {0: Unit(0, length, max(1, length // 4)), 1: Unit(1, words, max(1, words // 4))}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    half = lambda i: F.conv(F.substring("sha", i, 15), 16, 10).cast("long")
    rows = rows.withColumn("k1", half(1)).withColumn("k2", half(16))
    # `words` words have a byte each at least, and white space between them
    able = rows.where(F.octet_length("text") >= min(length, 2 * words - 1)).select("k1", "k2", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            for at, texts in pieces(b.column(2)):
                for unit in units.values():
                    yield from first_marks(k1[at:], k2[at:], all_symbols(texts, unit.kind), unit)

    def refine(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(3)
                cuts = lists.offsets.to_numpy()
                kind, at, back, fwd = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(4))
                for i, (k1, k2, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                    t, own = text.as_py().encode(), np.arange(cuts[i], cuts[i + 1])
                    for unit in units.values():
                        some = own[kind[own] == unit.kind]
                        s = symbols(t, unit.kind) if len(some) else None
                        for lo in range(0, len(some), 1000):
                            m = some[lo : lo + 1000]
                            yield finer_marks(k1, k2, s, at[m], back[m], fwd[m], unit, step)

        return run

    text = ["k1", "k2"]
    marks = put(able.mapInArrow(find, MARK).withColumn("batch", F.pmod("k1", F.lit(BATCHES)).cast("int")), "marks", by="batch")
    family = Family()
    for i in range(BATCHES):
        family.add(marks.where(F.col("batch") == i).select(*Family.KEY, _who().alias("who")))
    heads = family.matches()
    family.close()
    marks_read, marks = marks, marks.drop("batch")
    texts = able.dropDuplicates(text)
    covered = []
    for step in (*STEPS, 0):
        alive = put(marks.join(heads.hint("shuffle_hash"), Family.KEY, "left_semi"), "alive")
        drop(marks_read)
        drop(heads)
        if not step:
            covered.append(alive)
            break
        spans = _met(alive, "span", "end")
        told = put(alive.withColumn("who", _who()).join(spans.hint("shuffle_hash"), ["span", "end"], "left").drop("span", "end"), "told")
        drop(alive)
        drop(spans)
        covered.append(told.where("a is not null"))
        # an uncovered mark may share a part with a covered one: where a core has
        # both, each covered span's first place (of words also its last, as a
        # text is no partner of its own) goes on too
        edge = told.where("a is null")
        some = told.where("who = a or (kind = 1 and who = b)").join(put(edge.select(*Family.KEY).distinct(), "open").hint("shuffle_hash"), Family.KEY, "left_semi")
        rest = edge.unionByName(some).groupBy(*text).agg(F.collect_set(F.struct("kind", "at", "back", "fwd")).alias("marks"))
        marks = marks_read = put(texts.join(rest, text).select(*text, "text", "marks").mapInArrow(refine(step), MARK), "marks")
        heads = _met(marks, *Family.KEY)

    first = F.col("at") - F.col("back")
    ends = F.struct("kind", first.alias("s"), (first + F.col("fwd") + F.when(F.col("kind") == 0, length).otherwise(words)).alias("e"))
    slim = rows.select("id", *text, "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    copied = slim.groupBy(*text).agg(F.count("*").alias("c")).where("c > 1").select(*text, F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e")).alias("r"))
    ranges = copied
    for c in covered:
        ranges = ranges.unionByName(c.select(*text, ends.alias("r")))
    per_text = put(ranges.groupBy(*text).agg(F.collect_set("r").alias("ranges")), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, whole, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                t = whole.as_py().encode()
                spans, shared = ([(r["s"], r["e"]) for r in found if r["kind"] == k] for k in (0, 1))
                if any(r["kind"] == 2 for r in found):
                    n = len(symbols(t, 1))
                    spans, shared = [(0, len(t))] * (len(t) >= length), [(0, n)] * (n >= words)
                spans, kept, end = merge_ranges(spans), hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(t[end:s])
                    end = e
                kept.update(t[end:])
                out.append((k1, k2, sum(e - s for s, e in spans), len(spans), kept.hexdigest(), sum(e - s for s, e in merge_ranges(shared))))
            c = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept", "n_shared_words"])

    whole = rows.select(*text, "text").dropDuplicates(text)
    results = put(whole.join(per_text, text).select(*text, "text", "ranges").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept string, n_shared_words long"), "cut")
    return slim.join(results, text, "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"),
    )


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping ranges as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict[str, str] = {}
