"""Personal data: fixed patterns as seeds, and bootstrapped contextual ones."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shelf import put, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
Span = tuple[int, int, str]


def emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern finds, leftmost first, in linear time: from
    each @ back over local characters, then ahead over the domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers, taken in fours from the start of each chain."""
    out = []
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    out.append((at, end))
                at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(a, b, "ip") for a, b in ips(text)]
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(s: str) -> str:
    """Digit runs as 9, letter runs as a, other signs as they are; one of over
    40 signs ends in a digest of the whole."""
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    return out if len(out) <= 40 else f"{out[:40]}{_digest(out):x}"


def left_context(text: str, start: int, n: int = 2) -> str | None:
    """The n tokens that stand before start on its line, lower-cased, digits
    as 9; None where there are fewer."""
    width, got = 120, []
    while True:  # until the line's begin or a token more than asked for is seen
        _, cut, line = text[max(0, start - width) : start].rpartition("\n")
        got = line.lower().split()
        if cut or width >= start or len(got) > n:
            break
        width *= 4
    return re.sub(r"[0-9]+", "9", " ".join(got[-n:])) if len(got) >= n and (start == 0 or text[start - 1].isspace() or text[start - 1] in "(\"'<[") else None


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Spans that could be identifiers but that no seed touches: tokens, of any
    length, with four digits or an @ in them, trimmed of outer punctuation, joined where
    number-like ones follow each other by one space."""
    out: list[tuple[int, int]] = []
    number = False  # whether the last span has no letter
    for m in TOKEN.finditer(text):
        t = m.group()
        if "@" not in t and not any(map(str.isdigit, t)):
            continue
        a = m.start() + len(t) - len(t.lstrip("\"'(<[,;:"))
        b = m.start() + len(t.rstrip("\"')>],;:.!?"))
        if b - a < 2:
            continue
        letters = any(map(str.isalpha, text[a:b]))
        if number and not letters and out[-1][1] + 1 == a and text[a - 1] == " ":
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            number = not letters
    return [(a, b) for a, b in out if sum(c.isdigit() for c in text[a:b]) >= 4 or "@" in text[a:b] if not any(a < e and s < b for s, e, _ in base)]


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def edges(docs: DataFrame, text_col: str) -> DataFrame:
    """The pattern-instance graph: (pattern, instance, kind or null, n). A
    pattern is a left context with a shape; a context alone would say nothing
    of what it introduces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.column(0):
                text = t.as_py()
                if not text or not ("@" in text or DOTTED.search(text)):
                    continue
                base = base_spans(text)
                for s, e, k in base + [(s, e, None) for s, e in candidates(text, base)]:
                    left = left_context(text, s)
                    if left is not None:
                        seen[(left, _digest(text[s:e]), k, shape(text[s:e]))] += 1
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][3] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[0][2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                names=["left", "shape", "instance", "kind", "n"],
            )

    raw = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "left string, shape string, instance long, kind string, n long")
    return raw.groupBy("left", "shape", "instance", "kind").agg(F.sum("n").alias("n"))


def bootstrap(graph: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> list[tuple[str, str, str, float]]:
    """(left, shape, kind, confidence) of the patterns to trust.

    Seeds hold confidence 1 in their kind. Each round, a context's confidence
    in a kind is the confident share of the mentions it introduces, given
    `support` different confident instances; an unseen instance's is the
    confidence that not all of its contexts err; instances that gain `least`
    count from the next round on. Contexts that repeat are few next to
    mentions; all patterns to trust, the surest first, reach the driver.
    """
    mentions = put(graph, "mentions")
    # only contexts that introduce several instances can ever gain support; one
    # without a seed may gain it from instances found in an earlier round
    shared = mentions.groupBy("left").agg(F.count_distinct("instance").alias("c")).where("c >= 2").select("left")
    live = put(mentions.join(shared, "left", "left_semi"), "live")
    sure = live.where("kind is not null").select("instance", "kind").distinct().withColumn("conf", F.lit(1.0))
    patterns = None
    for _ in range(rounds):
        total = live.groupBy("left").agg(F.sum("n").alias("total"))
        patterns = (
            live.select("left", "instance", "n")
            .groupBy("left", "instance")
            .agg(F.sum("n").alias("n"))
            .join(sure, "instance")
            .groupBy("left", "kind")
            .agg(F.sum(F.col("n") * F.col("conf")).alias("good"), F.count("*").alias("support"))
            .join(total, "left")
            .select("left", "kind", (F.col("good") / F.col("total")).alias("conf"), "support")
            .where((F.col("support") >= support) & (F.col("conf") >= 0.5))
        )
        patterns = put(patterns, "patterns")
        found = (
            live.where("kind is null")
            .select("left", "instance")
            .distinct()
            .join(patterns, "left")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("conf"))
            .where(F.col("conf") >= least)
        )
        sure = put(live.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("conf")).unionByName(found).groupBy("instance", "kind").agg(F.max("conf").alias("conf")), "sure")
    best = patterns.where(F.col("conf") >= least).select("left", "kind", "conf")
    shapes = live.where("kind is null").select("left", "shape").distinct().join(best, "left")
    rows = shapes.orderBy(F.desc("conf"), "left", "shape", "kind").collect()
    return [(r["left"], r["shape"], r["kind"], r["conf"]) for r in rows]


def all_spans(text: str, patterns: dict[tuple[str, str], str]) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with what trusted patterns add."""
    if not ("@" in text or DOTTED.search(text)):
        return [], []
    base = base_spans(text)
    more = []
    if patterns:
        for s, e in candidates(text, base):
            kind = patterns.get((left_context(text, s), shape(text[s:e])))
            if kind:
                more.append((s, e, kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _table(patterns: list[tuple[str, str, str, float]]) -> dict[tuple[str, str], str]:
    out: dict[tuple[str, str], str] = {}
    for left, form, kind, _ in patterns:
        out.setdefault((left, form), kind)
    return out


def find(docs: DataFrame, patterns: list[tuple[str, str, str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row id_col, base (spans of the fixed patterns) and spans (all), as
    kind:start:end joined by commas, in code points. Null texts count as empty;
    null ids and repeated rows pass; extra columns are left out."""
    known = _table(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [all_spans(t.as_py() or "", known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([joined(x) for x, _ in got], pa.string()), pa.array([joined(y) for _, y in got], pa.string())], names=["id", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, base string, spans string").select(F.col("id").alias(id_col), "base", "spans")


def mask(docs: DataFrame, patterns: list[tuple[str, str, str, float]], text_col: str = "text") -> DataFrame:
    """docs with each span (overlapping ones as one, by the first's kind)
    replaced by its kind in angle brackets. Null texts stay null."""
    known = _table(patterns)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at):
                text = t.as_py()
                if text:
                    parts, end = [], 0
                    for s, e, k in all_spans(text, known)[1]:
                        if s >= end:
                            parts += [text[end:s], f"<{k}>"]
                        end = max(end, e)
                    text = "".join(parts) + text[end:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return docs.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, bootstrap(edges(docs, "text")))
    count = lambda k: F.regexp_count(F.concat(F.lit(","), "base"), F.lit(f",{k}:")).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data masked and n_chars as it then is. Null texts
    stay null, null ids and repeated rows are masked like others, other columns
    pass unchanged whatever they are named; an empty table stays empty."""
    out = mask(docs, bootstrap(edges(docs, "text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
