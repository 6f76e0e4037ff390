"""Structure-aware chunks of body blocks.

Blocks come sorted by document and place; one Arrow pass takes them in that
order and carries what it needs from batch to batch: the section in force, the
chunk being filled and the two before it. So a document of any length takes
time in proportion to it and no more memory than a few chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.config import ChunkConfig
from pagemill.functions.blocks import is_section, is_subsection, section_title
from pagemill.functions.text import WHITE, strip
from pagemill.operators.ingest import body_blocks
from pagemill.schemas import CHUNKS

_LEVELS = [(re.compile(rf"\n[{WHITE}]*\n"), "\n\n"), (re.compile(rf"(?<=[.!?])[{WHITE}]+"), " "), (re.compile(rf"[{WHITE}]+"), " ")]


def split_long(text: str, limit: int, level: int = 0) -> list[str]:
    """A text as pieces of at most limit: by paragraphs, then sentences, then
    words, then characters, as many as fit together. What is too long is split
    at the next finer level, and what a level split joins again; pieces of a
    paragraph and of a word stand alone."""
    if len(text) <= limit or level == len(_LEVELS):
        return [text[i : i + limit] for i in range(0, len(text) or 1, limit)]
    (gap, glue), out, last_free = _LEVELS[level], [], False
    for part in gap.split(text):
        if not part.strip(WHITE):
            continue
        free = level == 1 or len(part) <= limit
        for piece in split_long(part, limit, level + 1):
            joined = f"{out[-1]}{glue}{piece}".strip(WHITE) if free and last_free else ""
            if joined and len(joined) <= limit:
                out[-1] = joined
            else:
                out.append(piece)
            last_free = free
    return out


@dataclass(frozen=True)
class Chunk:
    text: str
    page_start: int
    page_end: int
    chunk_type: str
    section: str | None
    subsection: str | None
    clause_ids: tuple[str, ...] = ()


@dataclass
class Document:
    """What the pass knows of the document it is in."""

    document_id: object
    section: str | None = None
    subsection: str | None = None
    #: Kind of the block before, and whether it was a marker in one piece.
    prior: tuple[str, bool] | None = None
    #: The chunk being filled: its first piece's data, its pieces, their size.
    open: Chunk | None = None
    pieces: list[str] = field(default_factory=list)
    size: int = 0
    #: Finished chunks that may still be joined: to what comes, by what is
    #: behind them, at the end of the document.
    back: Chunk | None = None
    ahead: Chunk | None = None
    held: Chunk | None = None
    n: int = 0


def _both(a: Chunk, b: Chunk, second_leads: bool = False) -> Chunk:
    """a and b as one chunk, in this order; type, section, clauses and
    subsection are first those of the one that leads."""
    lead, other = (b, a) if second_leads else (a, b)
    return Chunk(
        f"{a.text}\n{b.text}".strip(WHITE),
        min(a.page_start, b.page_start),
        max(a.page_end, b.page_end),
        lead.chunk_type,
        lead.section,
        lead.subsection or other.subsection,
        tuple(dict.fromkeys(lead.clause_ids + other.clause_ids)),
    )


class Chunker:
    """Takes blocks one by one and gives chunks (document_id, n, chunk) as soon
    as nothing to come can change them.

    Structure demands a new chunk at a marker that follows something else, at a
    change between table and prose, at a text beyond max_chars and at each of
    its pieces; within what is left a clause begins one once target_chars is
    reached, and so does what would pass max_chars. A chunk keeps the section
    under which it began. Those under min_chars join the one before (same
    section and type, no table), the rest of them the one after, the last again
    the one before; never beyond max_chars + min_chars.
    """

    def __init__(self, cfg: ChunkConfig):
        self.cfg, self.doc, self.out = cfg, None, []

    def block(self, document_id: object, page: int, kind: str, text: str, clause_id: str | None, section: bool, subsection: bool, title: str | None) -> None:
        if self.doc is None or self.doc.document_id != document_id:
            self.finish()
            self.doc = Document(document_id)
        d, cfg = self.doc, self.cfg
        marker, chunk_type = section or subsection, "table" if kind == "table" else "prose"
        if section:
            d.section, d.subsection = title, None
        elif subsection:
            d.subsection = text
        pieces = split_long(text, cfg.max_chars)
        turn = d.prior is None or d.prior[0] != chunk_type or (marker and not d.prior[1]) or len(text) > cfg.max_chars
        for i, piece in enumerate(pieces):
            if turn or i or (kind == "clause" and d.size >= cfg.target_chars) or d.size + len(piece) > cfg.max_chars:
                self._close()
                d.open = Chunk("", page, page, chunk_type, d.section, d.subsection)
                turn = False
            d.pieces.append(piece)
            d.size += len(piece)
            clauses = d.open.clause_ids if clause_id is None or clause_id in d.open.clause_ids else (*d.open.clause_ids, clause_id)
            d.open = replace(d.open, page_end=page, clause_ids=clauses)
        d.prior = chunk_type, marker and len(pieces) == 1

    def _close(self) -> None:
        """The chunk being filled is complete."""
        d = self.doc
        if d.open is not None and (text := "\n".join(d.pieces).strip(WHITE)):
            self._back(replace(d.open, text=text))
        d.open, d.pieces, d.size = None, [], 0

    def _small(self, c: Chunk) -> bool:
        return len(c.text) < self.cfg.min_chars and c.chunk_type != "table"

    def _fit(self, a: Chunk, b: Chunk) -> bool:
        return len(a.text) + len(b.text) <= self.cfg.max_chars + self.cfg.min_chars

    def _back(self, x: Chunk) -> None:
        d, p = self.doc, self.doc.back
        if self.cfg.min_chars <= 0:
            self._put(x)
        elif p is not None and self._small(x) and x.chunk_type == p.chunk_type and x.section == p.section and self._fit(p, x):
            d.back = _both(p, x)
        else:
            if p is not None:
                self._ahead(p)
            d.back = x

    def _ahead(self, x: Chunk) -> None:
        d, p = self.doc, self.doc.ahead
        if p is not None and self._small(p) and x.chunk_type == p.chunk_type and (x.section or "") == (p.section or "") and self._fit(p, x):
            d.ahead = _both(p, x, second_leads=True)
        else:
            if p is not None:
                if d.held is not None:
                    self._put(d.held)
                d.held = p
            d.ahead = x

    def _put(self, c: Chunk) -> None:
        self.out.append((self.doc.document_id, self.doc.n, c))
        self.doc.n += 1

    def finish(self) -> None:
        """The document ends here."""
        if self.doc is None:
            return
        self._close()
        d = self.doc
        if d.back is not None:
            self._ahead(d.back)
        p, x = d.held, d.ahead
        if p is not None and self._small(x) and (p.section or "") == (x.section or "") and self._fit(p, x):
            p, x = None, _both(p, x)
        for c in (p, x):
            if c is not None:
                self._put(c)
        self.doc = None


_CHUNK = "document_id string, n int, text string, page_start int, page_end int, chunk_type string, section string, subsection string, clause_ids array<string>"
#: Chunks that the pass gives at once.
BATCH = 4096


def chunks_of(body: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """(document_id, n, ...) of each document's chunks. One shuffle and one
    sort, by document and place, then the pass; the blocks of one document meet
    in a task, in whose memory only a few chunks of it are."""
    tasks = int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = body.withColumn("title", F.when(F.col("is_section"), F.col("title")))
    # equal places stand in the order of their texts
    dealt = rows.repartition(tasks, "document_id").sortWithinPartitions("document_id", "page_number", "reading_order", "text")

    def record(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        cols = zip(*[(i, n, c.text, c.page_start, c.page_end, c.chunk_type, c.section, c.subsection, list(c.clause_ids)) for i, n, c in rows], strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chunker(cfg)
        for b in batches:
            for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
                c.block(*row)
                if len(c.out) >= BATCH:
                    yield record(c.out)
                    c.out = []
        c.finish()
        yield record(c.out)

    return dealt.select("document_id", "page_number", "type", "text", "clause_id", "is_section", "is_subsection", "title").mapInArrow(run, _CHUNK)


def context_text(product: Column, section: Column, subsection: Column, text: Column, prefix: bool = True) -> Column:
    """The text under its breadcrumb of product, section and subsection; the
    section is left out where the text begins with it."""
    if not prefix:
        return text
    begins = F.lower(F.left(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(30))).startswith(F.lower(F.left(section, F.lit(30))))
    crumbs = F.concat_ws(" > ", F.nullif(product, F.lit("")), F.when(~begins, F.nullif(section, F.lit(""))), F.when(~F.coalesce(subsection == section, F.lit(False)), F.nullif(subsection, F.lit(""))))
    return F.when(crumbs == "", text).otherwise(F.concat(crumbs, F.lit("\n"), text))


def chunk(blocks: DataFrame, meta: DataFrame | None = None, cfg: ChunkConfig | None = None) -> DataFrame:
    """chunks (schemas.CHUNKS) of typed blocks; meta: document_id and any of
    filename, insurer, product, uin, document_type, source_path. One document's
    blocks pass through one task in order."""
    cfg = cfg or ChunkConfig()
    for c, kind in (("subtype", "string"), ("heading_level", "int"), ("clause_id", "string")):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(kind))
    body = body_blocks(blocks).select(
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce("page_number", F.lit(0)).cast("int").alias("page_number"),
        F.coalesce("reading_order", F.lit(0)).cast("int").alias("reading_order"),
        F.coalesce("type", F.lit("paragraph")).alias("type"),
        strip(F.col("text")).alias("text"),
        "clause_id",
        is_section(F.col("type"), F.col("subtype"), F.col("text")).alias("is_section"),
        is_subsection(F.col("type"), F.col("subtype"), F.col("heading_level")).alias("is_subsection"),
        section_title(F.col("text")).alias("title"),
    )
    made = chunks_of(body, cfg)
    fields = ["filename", "insurer", "product", "uin", "document_type", "source_path"]
    if meta is None:
        made = made.select("*", *[F.lit(None).cast("string").alias(c) for c in fields])
    else:
        have = meta.select(F.col("document_id").cast("string").alias("document_id"), *[F.col(c).cast("string") if c in meta.columns else F.lit(None).cast("string").alias(c) for c in fields])
        made = made.join(have.withColumn("source_path", F.regexp_extract("source_path", r"([^/]*)$", 1)), "document_id", "left")
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return (
        made.withColumn("chunk_id", F.format_string("%s::c%04d", "document_id", "n"))
        .withColumn("context_text", context_text(F.col("product"), F.col("section"), F.col("subsection"), F.col("text"), cfg.context_prefix))
        .withColumn("char_count", F.length("text"))
        .withColumn("word_count", F.size(F.split(strip(F.col("text")), r"(?U)\s+")))
        .withColumn("embedding_model", F.lit(None).cast("string"))
        .select(*names)
    )


def store_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as scalar metadata: lists joined by commas, nulls empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return chunks.select("chunk_id", "context_text", *[text(c) for c in ("document_id", "filename", "insurer", "product", "uin", "document_type", "section", "subsection", "chunk_type", "embedding_model")], F.coalesce(F.array_join("clause_ids", ","), F.lit("")).alias("clause_ids"), F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"))


def index_text(chunks: DataFrame) -> DataFrame:
    """What lexical indexing reads of chunks."""
    return chunks.select("chunk_id", F.coalesce(F.nullif("context_text", F.lit("")), "text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("document_id", "product", "chunk_type")])
