"""From extracted blocks to canonical pages, structure, registry and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import blocks as B
from pagemill.functions import pages as H
from pagemill.functions.text import clause_number, has_unicode_issues, normalize_text, strip


def html_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(document_id, page_number 1, reading_order, text, tag) blocks of web
    pages: the texts of headings, paragraphs and list items."""
    body = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-6]|p|li|td|title)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|td|title|div|ul|nav|footer|article)\b|$)"), 1)
    return pages.select(F.col(id_col).cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(parts).alias("reading_order", "raw")).select("document_id", "page_number", "reading_order", strip(F.regexp_replace("raw", r"<[^>]*>", " ")).alias("text"))


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line of a text as a block of page 1."""
    return docs.select(F.col(id_col).alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(F.split(F.col(text_col), "\n")).alias("reading_order", "text"))


def flatten(documents: DataFrame) -> DataFrame:
    """Nested documents (pages of blocks) as one row a block."""
    page = documents.select("document_id", F.explode("pages").alias("p"))
    rows = page.select("document_id", F.col("p.page_number").alias("_n"), F.col("p.page_width").alias("page_width"), F.col("p.page_height").alias("page_height"), F.explode("p.blocks").alias("b")).select("document_id", "_n", "page_width", "page_height", "b.*")
    own = F.coalesce("page_number", "_n") if "page_number" in rows.columns else F.col("_n")
    return rows.withColumn("page_number", own).drop("_n")


def nest(blocks: DataFrame) -> DataFrame:
    """One row a document: pages in order, each with its blocks in order."""
    fields = [c for c in blocks.columns if c not in ("document_id", "page_number")]
    pages = blocks.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", *[c for c in fields if c != "reading_order"]))).alias("blocks"))
    return pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "blocks"))).alias("pages"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Numbers each page's blocks by rounded top, then rounded left edge."""
    w = Window.partitionBy("document_id", "page_number").orderBy(F.bround(F.get("bbox", F.lit(1))), F.bround(F.get("bbox", F.lit(0))), "block_id")
    return blocks.withColumn("reading_order", F.row_number().over(w) - 1)


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Adds type, subtype, confidence and clause number (of the raw text), the
    cleaned text, heading level, counts and the Unicode flag. Style columns
    that are absent count as unknown."""
    for c, kind in (("font_size", "double"), ("is_bold", "boolean"), ("is_upper", "boolean"), ("bbox", "array<double>")):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(kind))
    style = [F.col(c) for c in ("font_size", "is_bold", "is_upper")]
    # step by step, so that what several rules read is worked out once a row
    out = blocks.withColumn("raw_text", F.col("text")).withColumn("_t", strip(F.col("raw_text")))
    out = out.withColumn("_l", B._lines(F.col("_t"))).withColumn("clause_number", clause_number(F.col("raw_text")))
    out = out.withColumn("_k", B.classify_from(F.col("_t"), F.col("_l"), F.col("clause_number"), *style, F.col("bbox"))).withColumn("heading_level", B.heading_level(F.col("raw_text"), *style))
    out = out.withColumn("type", F.col("_k.type")).withColumn("subtype", F.col("_k.subtype")).withColumn("classification_confidence", F.col("_k.confidence")).drop("_k", "_l", "_t")
    out = out.withColumn("text", normalize_text(F.coalesce("raw_text", F.lit("")))).withColumn("_s", strip(F.col("text")))
    return out.withColumn("char_count", F.length("text")).withColumn("word_count", F.when(F.col("_s") == "", 0).otherwise(F.size(F.split("_s", r"(?U)\s+")))).withColumn("has_unicode_issues", has_unicode_issues(F.col("raw_text"))).withColumn("clause_id", F.col("clause_number")).drop("_s")


def with_ocr(blocks: DataFrame, ocr: DataFrame, least_chars: int = 50) -> DataFrame:
    """Adds a block of OCR text to pages with fewer native characters than
    least_chars. ocr: (document_id, page_number, ocr_text)."""
    native = blocks.groupBy("document_id", "page_number").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n"), F.max("reading_order").alias("last"))
    extra = (
        ocr.where(strip(F.col("ocr_text")) != "")
        .join(native, ["document_id", "page_number"], "left")
        .where(F.coalesce("n", F.lit(0)) < least_chars)
        .select("document_id", "page_number", (F.coalesce("last", F.lit(-1)) + 1).alias("reading_order"), F.col("ocr_text").alias("text"), F.lit(True).alias("ocr_used"))
    )
    return blocks.withColumn("ocr_used", F.lit(False)).unionByName(extra, allowMissingColumns=True)


def page_sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, bitmap, last) of the distinct page numbers of each key: a
    bitmap of 4 KB for 32,768 numbers, combined before the shuffle, and the
    last bit that is set."""
    page = F.col("page_number").cast("long")
    at = F.bitmap_bit_position(page)
    sets = rows.where("page_number is not null").groupBy(*keys, F.bitmap_bucket_number(page).alias("bucket"))
    return sets.agg(F.bitmap_construct_agg(at).alias("bitmap"), F.max(at).alias("last"))


def pages_of(bucket: Column, bitmap: Column, last: Column) -> Column:
    """The page numbers of a bucket's bitmap, up to the last bit that is set."""
    octet = lambda i: F.conv(F.hex(F.substring(bitmap, (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda i: octet(i).bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) > 0
    number = lambda i: F.when(bucket > 0, (bucket - 1) * 32768 + i + 1).otherwise(bucket * 32768 - i)
    return F.transform(F.filter(F.sequence(F.lit(0), last.cast("int")), is_set), number)


def repeated_bands(blocks: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(document_id, band, text, frequency, pages) of texts that stand in the
    top 15 % or bottom 10 % of max(2, pages * share) pages. blocks: document_id,
    page_number, text, y (top edge as a share of the page's height).

    Pages are gathered only for the texts that repeat, as bitmaps. A text on
    no numbered page has an empty list."""
    keys = ["document_id", "band", "text"]
    band = F.when(F.col("y") < 0.15, "header").when(F.col("y") > 0.90, "footer")
    pages = blocks.groupBy("document_id").agg(F.count_distinct("page_number").alias("n_pages"))
    rows = blocks.select("document_id", "page_number", strip(F.col("text")).alias("text"), band.alias("band")).where("band is not null and text <> ''")
    found = rows.groupBy(*keys).agg(F.count("*").alias("frequency")).join(pages, "document_id")
    often = found.where(F.col("frequency") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * share))).drop("n_pages")
    kind = blocks.schema["page_number"].dataType.simpleString()
    sets = page_sets(rows.join(often.select(*keys), keys, "left_semi"), keys).select(*keys, "bucket", pages_of(F.col("bucket"), F.col("bitmap"), F.col("last")).alias("p"))
    listed = sets.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("p"))).cast(f"array<{kind}>").alias("pages"))
    return often.join(listed, keys, "left").withColumn("pages", F.coalesce("pages", F.expr(f"cast(array() as array<{kind}>)")))


def mark_bands(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Blocks in a repeated band become header or footer and leave the body."""
    band = F.when(F.col("y") < 0.15, "header").when(F.col("y") > 0.90, "footer")
    keyed = blocks.withColumn("_band", band).withColumn("_text", strip(F.col("text")))
    known = bands.select("document_id", F.col("band").alias("_band"), F.col("text").alias("_text"), F.lit(True).alias("is_repeated"))
    out = keyed.join(known, ["document_id", "_band", "_text"], "left").withColumn("is_repeated", F.coalesce("is_repeated", F.lit(False)))
    return out.withColumn("type", F.when(F.col("is_repeated"), F.col("_band")).otherwise(F.col("type"))).withColumn("include_in_chunk_text", ~F.col("is_repeated")).drop("_band", "_text")


def body_blocks(blocks: DataFrame) -> DataFrame:
    keep = F.coalesce(F.col("include_in_chunk_text"), F.lit(True)) if "include_in_chunk_text" in blocks.columns else F.lit(True)
    return blocks.where(~F.coalesce("type", F.lit("paragraph")).isin("header", "footer") & keep & (strip(F.col("text")) != ""))


def structure(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings and clauses, with the first 200 characters of each."""
    base = ["document_id", "page_number", "reading_order"]
    heads = blocks.where((F.col("type") == "heading") | F.coalesce("subtype", F.lit("")).contains("heading")).select(*base, "heading_level", F.left("text", F.lit(200)).alias("text"))
    clauses = blocks.where(F.coalesce("clause_number", F.lit("")) != "").select(*base, "clause_number", F.left("text", F.lit(200)).alias("text"))
    return heads, clauses


def carry_sections(blocks: DataFrame) -> DataFrame:
    """section and subsection in force at each block; a new section ends the
    subsection. blocks: document_id, ord, is_section, is_subsection, title."""
    run = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks.withColumn("section", F.last(F.when(F.col("is_section"), F.col("title")), ignorenulls=True).over(run)).withColumn("_s", F.sum(F.col("is_section").cast("int")).over(run))
    within = Window.partitionBy("document_id", "_s").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("subsection", F.last(F.when(F.col("is_subsection") & ~F.col("is_section"), F.col("title")), ignorenulls=True).over(within)).drop("_s")


def inspect_html(pages: DataFrame) -> DataFrame:
    """Counts of web pages and whether they would need OCR."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    rows = pages.select("page_id", F.length(text).cast("long").alias("char_count"), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long").alias("word_count"), n("(?i)<p[ >]").alias("block_count"), n("(?i)<img[ >]").alias("image_count"), n("(?i)<h1[ >]").alias("heading_count"))
    need = B.ocr_need(F.col("char_count"), F.col("block_count"), F.lit(0.0), F.col("image_count"), F.lit(0.0), F.lit(1))
    return rows.select("*", *[v.alias(k) for k, v in need.items()])


def review_candidates(inspected: DataFrame) -> DataFrame:
    """(page key, reason): the first of OCR used, low text and tables that
    holds, else cover page and heading-only page on their own. inspected:
    page_id, page_number, char_count, ocr_used, n_tables, n_headings."""
    first = F.when(F.col("ocr_used"), F.array(F.lit("ocr_processed_page"))).when(F.col("char_count") < 50, F.array(F.lit("low_text_content"))).when(F.col("n_tables") > 0, F.array(F.lit("table_page")))
    rest = F.array_compact(F.array(F.when(F.col("page_number") == 1, "cover_page"), F.when((F.col("n_headings") > 0) & (F.col("char_count") < 200), "heading_only_page")))
    return inspected.select("page_id", "page_number", "char_count", F.explode(F.coalesce(first, rest)).alias("reason"))


def suspicious_pages(inspected: DataFrame) -> DataFrame:
    why = F.when((F.col("char_count") == 0) & (F.col("image_count") > 0), "no_text_with_images").when((F.col("char_count") < 50) & (F.col("image_count") > 0), "very_low_text_with_images")
    return inspected.select("page_id", "char_count", "image_count", why.alias("reason")).where("reason is not null")


def ocr_boxes(blocks: DataFrame, dpi: int = 300) -> DataFrame:
    """Pixel boxes of rendered pages as points within the page. blocks: bbox,
    page_width, page_height."""
    s = 72.0 / dpi
    clamp = lambda i, side: F.least(F.greatest(F.get("bbox", F.lit(i)) * s, F.lit(0.0)), F.col(side))
    return blocks.withColumn("bbox", F.array(clamp(0, "page_width"), clamp(1, "page_height"), clamp(2, "page_width"), clamp(3, "page_height")))


def ocr_confidence(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id", "page_number").agg(F.avg("confidence").alias("ocr_confidence_mean"), F.min("confidence").alias("ocr_confidence_min"))


def numbered(df: DataFrame, by: str, parts: int = 64) -> DataFrame:
    """df with n, its rows' place from 1 in the order of `by` (no two alike).

    Rows are dealt into ranges at the values of a small sample, numbered within
    their range, and moved by the ranges before; where the cuts fall changes
    the work, not the numbers."""
    sample = [r[0] for r in df.select(by).where(F.col(by).isNotNull()).orderBy(F.xxhash64(by), by).limit(20 * parts).collect()]
    cuts = sorted(sample)[20::20]
    at = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(by)))
    rows = df.withColumn("_r", F.coalesce(at, F.lit(0)))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_size").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_b")  # a row a range
    own = F.row_number().over(Window.partitionBy("_r").orderBy(by))
    return rows.withColumn("_o", own).join(F.broadcast(before), "_r").withColumn("n", (F.col("_b") + F.col("_o")).cast("int")).drop("_r", "_o", "_b")


def registry(files: DataFrame) -> DataFrame:
    """Registry rows of (path, text[, checksum]): ids by sorted path, metadata,
    the first earlier document with the same content, and the first earlier one
    with the same policy number."""
    out = files.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
    for k, v in B.metadata("text", "filename").items():
        out = out.withColumn(k, v)
    if "checksum" not in out.columns:
        out = out.withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = numbered(out, "path")
    name = lambda c: F.format_string("DOC-%03d", c)
    for key, into in (("checksum", "duplicate_of"), ("uin", "variant_of")):
        first = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("n").alias("_f"))
        out = out.join(first, key, "left").withColumn(into, F.when(F.col("_f") < F.col("n"), name(F.col("_f")))).drop("_f")
    flags = F.concat("review_flags", F.array_compact(F.array(F.when(F.col("variant_of").isNotNull(), F.concat(F.lit("possible_version_variant_of_"), F.col("variant_of"))), F.when(F.col("duplicate_of").isNotNull(), F.lit("exact_duplicate")))))
    return out.select(name(F.col("n")).alias("document_id"), "path", "filename", "insurer", "product", "uin", "document_type", "version", "checksum", "duplicate_of", "variant_of", flags.alias("review_flags"))


def with_status(rows: DataFrame, outcome: DataFrame | None = None) -> DataFrame:
    """Registry rows stamped with the time, `pending` or, given the outcome
    (document_id, status), as it says; a document without one has failed."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows = rows.withColumn("ingested_at", stamp)
    if outcome is None:
        return rows.withColumn("status", F.lit("pending"))
    rows = rows.drop("status")
    return rows.join(outcome.select("document_id", "status"), "document_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def cover_texts(pages: DataFrame, first: int = 5, typed: int = 2) -> DataFrame:
    """(document_id, cover_text, first_text) of pages (document_id, page_number,
    text): the first `first` pages and the last, joined by lines, from which
    metadata are read; the first `typed`, which tell the document's type."""
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("_last"))
    # page numbers decide, so that all other pages are left out before they meet
    some = pages.join(last, "document_id").where((F.col("page_number") <= first) | (F.col("page_number") == F.col("_last")))
    got = some.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    text = lambda l: F.array_join(F.transform(l, lambda x: x["t"]), "\n")
    return got.select("document_id", text(F.col("l")).alias("cover_text"), text(F.filter("l", lambda x: x["page_number"] <= typed)).alias("first_text"))


def detected_tables(blocks: DataFrame, raw_indent: bool = False) -> DataFrame:
    """(document_id, page_number, reading_order, text, detection_method,
    has_unicode_issues) of blocks that are tables, their text cleaned."""
    found = blocks.withColumn("detection_method", H.table_method(F.col("text"), raw_indent)).where("detection_method is not null")
    clean = H.clean_table(F.left("text", F.lit(1000)), 1000)
    return found.select("document_id", "page_number", "reading_order", F.left(clean, F.lit(500)).alias("text"), "detection_method", clean.contains("\ufffd").alias("has_unicode_issues"))


def page_signals(blocks: DataFrame, raw_indent: bool = False) -> DataFrame:
    """Per page: characters, how many blocks look tabular, whether a line
    begins a numbered clause, whether one is a heading."""
    t = F.coalesce("text", F.lit(""))
    rows = blocks.select("document_id", "page_number", F.length(t).alias("n"), H.looks_tabular(t, raw_indent).alias("tab"), H.has_clauses(t).alias("clause"), H.has_heading_line(t).alias("head"))
    return rows.groupBy("document_id", "page_number").agg(F.sum("n").alias("char_count"), F.count_if("tab").alias("n_tables"), F.max("tab").alias("has_tables"), F.max("clause").alias("has_numbered_clauses"), F.max("head").alias("has_headings"))


def normalize_pages(blocks: DataFrame, ocr: DataFrame | None = None, share: float = 1 / 3) -> DataFrame:
    """Extracted blocks (document_id, page_number, block_id, text, bbox,
    page_height and style columns where known) as canonical ones: in reading
    order, typed by their raw text, cleaned, with OCR text where a page has
    little of its own, and repeated headers and footers marked."""
    out = reading_order(blocks)
    if ocr is not None:
        out = with_ocr(out, ocr)
    out = normalize_blocks(out).withColumn("y", F.coalesce(F.try_divide(F.get("bbox", F.lit(1)), F.col("page_height")), F.lit(0.5)))
    return mark_bands(out, repeated_bands(out, share))


def document_report(pages: DataFrame, inspected: DataFrame, registered: DataFrame) -> DataFrame:
    """One row per registered document, its normalised pages (document_id,
    page_number, char_count, ocr_used, n_tables) and inspected ones
    (document_id, page_number, char_count, image_count) joined by id, so a
    document that failed misaligns no other."""
    seen = inspected.select("document_id", "page_number", F.col("char_count").alias("_c"), F.col("image_count").alias("_i"))
    odd = F.when((F.col("_c") == 0) & (F.col("_i") > 0), "no_text_with_images").when((F.col("_c") < 50) & (F.col("_i") > 0), "very_low_text_with_images")
    per = (
        pages.join(seen, ["document_id", "page_number"], "left")
        .groupBy("document_id")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(~F.col("ocr_used") & (F.col("char_count") > 50)).alias("native_text_pages"),
            F.count_if("ocr_used").alias("ocr_pages"),
            F.coalesce(F.sum("_i"), F.lit(0)).cast("long").alias("images"),
            F.coalesce(F.sum("n_tables"), F.lit(0)).cast("long").alias("tables"),
            F.count_if(odd.isNotNull()).alias("suspicious_pages"),
            F.sum("char_count").cast("long").alias("chars"),
        )
    )
    counts = ["pages", "native_text_pages", "ocr_pages", "images", "tables", "suspicious_pages", "chars"]
    return registered.join(per, "document_id", "left").select(*registered.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def exact_duplicates(rows: DataFrame, id_col: str, checksum_col: str) -> DataFrame:
    """Groups of equal content: checksum, size, least and greatest id. (Sums
    instead of lists, so a group of any size is one small row.)"""
    return rows.groupBy(checksum_col).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def duplicate_of(rows: DataFrame, id_col: str, checksum_col: str) -> DataFrame:
    first = rows.groupBy(checksum_col).agg(F.min(id_col).alias("_f"))
    return rows.join(first, checksum_col).where(F.col("_f") < F.col(id_col)).select(id_col, F.col("_f").alias("duplicate_of"))


def version_variants(rows: DataFrame, product: str, version: str) -> DataFrame:
    """Products of several versions, with these."""
    found = rows.select(product, version).distinct().groupBy(product).agg(F.sort_array(F.collect_list(version)).alias("versions"))
    return found.where(F.size("versions") > 1)


def extraction_report(pages: DataFrame) -> DataFrame:
    """Per document, and over all (document_id null): pages, pages with text,
    OCR pages, characters, words. pages: document_id, char_count, word_count, ocr_used."""
    return pages.rollup("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("char_count") > 0).alias("text_pages"), F.count_if(F.col("ocr_used")).alias("ocr_pages"), F.sum("char_count").alias("chars"), F.sum("word_count").alias("words"))
