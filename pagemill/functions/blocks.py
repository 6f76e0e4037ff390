"""Typing of text blocks, page layout and document metadata, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import clause_number, strip

BULLETS = "*-•◆◇→∙"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def heading(text: Column, n_lines: Column, font_size: Column, is_bold: Column, is_upper: Column, bbox: Column) -> tuple[Column, Column]:
    """(level, confidence) by capitals, font, weight and width; nulls if none."""
    size, bold, caps = F.length(text), F.coalesce(is_bold, F.lit(False)), F.coalesce(is_upper, F.lit(False))
    by_caps = _upper(text) & (size < 100)
    by_font = (F.coalesce(font_size, F.lit(0.0)) > 14) & (n_lines <= 3) & (size < 200)
    bold_one = bold & (n_lines == 1) & (size < 80)
    bold_two = bold & (n_lines <= 2) & (size < 120)
    narrow = (F.size(bbox) == 4) & (F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0)) < 240) & (n_lines <= 2) & caps & (size < 80)
    narrow = F.coalesce(narrow, F.lit(False))
    level = F.when(narrow, 1).when(bold_one | bold_two, 2).when(by_caps | by_font, 1)
    part = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    conf = F.greatest(part(by_caps, 0.7), part(by_font, 0.6), part(bold_one, 0.8), part(bold_two, 0.7), part(narrow, 0.75))
    return F.when(conf >= 0.6, level), F.when(conf >= 0.6, conf)


def aligned(lines: Column) -> Column:
    """Three lines or more, two double gaps in one of the first five. (Lines
    are stripped, so their indents never differ.)"""
    gaps = lambda x: F.size(F.regexp_extract_all(x, F.lit(" (?= )"), 0))
    return (F.size(lines) >= 3) & F.exists(F.slice(lines, 1, 5), lambda x: gaps(x) >= 2)


def classify(text: Column, font_size: Column | None = None, is_bold: Column | None = None, is_upper: Column | None = None, bbox: Column | None = None) -> Column:
    """struct(type, subtype, confidence) of a block's raw text; first rule wins."""
    t = strip(text)
    return classify_from(t, _lines(t), clause_number(t), font_size, is_bold, is_upper, bbox)


def classify_from(t: Column, lines: Column, clause: Column, font_size: Column | None = None, is_bold: Column | None = None, is_upper: Column | None = None, bbox: Column | None = None) -> Column:
    """classify() of a stripped text, its lines and its clause number: given as
    columns, they are worked out once a row."""
    null = lambda t: F.lit(None).cast(t)
    tabbed = F.filter(lines, lambda x: x.contains("\t"))
    level, conf = heading(t, F.size(lines), font_size if font_size is not None else null("double"), is_bold if is_bold is not None else null("boolean"), is_upper if is_upper is not None else null("boolean"), bbox if bbox is not None else null("array<double>"))
    bare = F.regexp_replace(t, r"\.+\z", "")
    kind = lambda a, b, c: F.struct(F.lit(a).alias("type"), F.lit(b).cast("string").alias("subtype"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    sub = F.struct(F.lit("heading").alias("type"), F.concat(F.lit("subsection_heading_l"), level.cast("string")).alias("subtype"), conf.cast("double").alias("confidence"))
    return (
        F.when(t == "", kind("paragraph", None, 1.0))
        .when(clause.isNotNull(), kind("clause", "numbered_clause", 0.9))
        .when((F.size(lines) >= 2) & (F.size(tabbed) >= 2), kind("table", "tab_separated", 0.8))
        .when(aligned(lines), kind("table", "aligned_columns", 0.7))
        .when(F.get(lines, F.lit(0)).rlike(rf"^[*\-{BULLETS[2:]}]\s+"), kind("list_item", "bulleted_list", 0.8))
        .when((F.length(t) < 100) & (F.size(lines) <= 2) & bare.rlike(r"^(\d+|\d+\s*/\s*\d+)$"), kind("footer", "page_number", 0.7))
        .when(level == 1, kind("heading", "section_heading", conf))
        .when(level.isNotNull(), sub)
        .otherwise(kind("paragraph", None, 1.0))
    )


def heading_level(text: Column, font_size: Column, is_bold: Column, is_upper: Column) -> Column:
    t, bold, caps = strip(text), F.coalesce(is_bold, F.lit(False)), F.coalesce(is_upper, F.lit(False))
    rule = F.when((font_size > 18) | (bold & caps & (F.length(t) < 80)), 1).when((font_size > 14) | (bold & (F.size(F.split(t, "\n")) <= 2)), 2).when((font_size > 12) & bold, 3)
    return F.when((font_size > 0) & (t != ""), rule)


def layout_type(xs: Column, page_width: Column) -> Column:
    """single_column, two_column or mixed, from the sorted left edges of a page's blocks."""
    x = F.array_sort(xs)
    steps = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(1))), x, lambda b, a: b - a)
    gaps = F.filter(steps, lambda g: g > 50)
    left = F.size(F.filter(x, lambda v: v < page_width / 2))
    right = F.size(x) - left
    top = F.array_max(gaps)
    split = (F.size(x) >= 4) & (F.size(gaps) >= 2) & (top > 200) & (left > 0) & (right > 0)
    return F.when(~F.coalesce(split, F.lit(False)), "single_column").when(left > right, F.when(left > 5, "two_column").otherwise("mixed")).otherwise(F.when(top > 300, "two_column").otherwise("mixed"))


SECTION_LIKE = r"^[A-Z]\.\s+[A-Z][A-Z&/\-']+"


def is_section(type_: Column, subtype: Column, text: Column) -> Column:
    return F.coalesce(((type_ == "heading") & (subtype == "section_heading")) | ((type_ == "clause") & strip(text).rlike(SECTION_LIKE)), F.lit(False))


def is_subsection(type_: Column, subtype: Column, level: Column) -> Column:
    return F.coalesce((type_ == "heading") & ((subtype == "subsection_heading_l2") | (F.coalesce(level, F.lit(0)) >= 3)), F.lit(False))


def section_title(text: Column) -> Column:
    t = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    lettered = strip(F.regexp_extract(t, r"^([A-Z]\.\s+(?:[A-Z][A-Z&/\-']+(?:\s|$))+)", 1))
    return F.when(F.length(lettered) >= 4, lettered).otherwise(F.left(t, F.lit(80)))


# What names an insurer or a product in a policy's text, and in
# its file name; the first that fits counts.
INSURERS = [
    ("hdfc ergo", "HDFC ERGO General Insurance Company Limited"),
    ("niva bupa", "Niva Bupa Health Insurance Company Limited"),
    ("care health", "Care Health Insurance Limited"),
    ("icici lombard", "ICICI Lombard General Insurance Company Limited"),
    ("star health", "Star Health and Allied Insurance Company Limited"),
    ("go digit", "Go Digit General Insurance Limited"),
    ("tata aig", "Tata AIG General Insurance Company Limited"),
    ("aditya birla", "Aditya Birla Health Insurance Company Limited"),
    ("new india", "The New India Assurance Company Limited"),
]
PRODUCTS = [
    (r"my:?[\s-]*optima[\s-]*secure", "my:Optima Secure"),
    (r"reassure\s*2\.0", "ReAssure 2.0"),
    (r"ultimate\s*care", "Ultimate Care"),
    (r"elevate\b", "Elevate"),
    (r"star\s*comprehensive", "Star Comprehensive"),
    (r"digit\s*health\s*insurance\s*policy", "Digit Health Insurance Policy"),
    (r"medi\s*care", "MediCare"),
    (r"activ\s*one", "Activ One"),
]
FILE_INSURERS = [
    (["hdfc"], "HDFC ERGO General Insurance Company Limited"),
    (["niva", "nbhl", "reassure"], "Niva Bupa Health Insurance Company Limited"),
    (["care", "chihlip"], "Care Health Insurance Limited"),
    (["icici"], "ICICI Lombard General Insurance Company Limited"),
    (["star"], "Star Health and Allied Insurance Company Limited"),
    (["digit"], "Go Digit General Insurance Limited"),
    (["tata"], "Tata AIG General Insurance Company Limited"),
    (["aditya", "birla"], "Aditya Birla Health Insurance Company Limited"),
    (["newindia", "policyclause"], "The New India Assurance Company Limited"),
]
FILE_PRODUCTS = [
    (["optima"], "my:Optima Secure"), (["reassure"], "ReAssure 2.0"), (["ultimate"], "Ultimate Care"), (["elevate"], "Elevate"),
    (["star", "comprehensive"], "Star Comprehensive"), (["digit"], "Digit Health Insurance Policy"), (["medicare", "tata"], "MediCare"),
    (["mediclaim", "newindia"], "MediClaim Policy"), (["activ"], "Activ One"),
]
DOCUMENT_TYPES = [
    (r"policy\s*wording", "Policy Wording"),
    (r"policy\s*clause", "Policy Clause"),
    (r"prospectus", "Prospectus"),
    (r"policy\s*document", "Policy Document"),
    (r"policy\s*terms\s*and\s*conditions", "Policy Terms and Conditions"),
]
FILE_TYPES = [
    (["prospectus"], "Prospectus"), (["terms-and-conditions"], "Policy Terms and Conditions"), (["policy-clause", "policyclause"], "Policy Clause"),
    (["policy-document"], "Policy Document"), (["policy-wording"], "Policy Wording"),
]
UIN = r"[A-Z]{3,6}LIP\d{4,6}[A-Z]?\d{4,6}"


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def metadata(text: str, filename: str) -> dict[str, Column]:
    """insurer, product, uin, document_type, version and review flags of a
    document's cover text, with what its file name tells where that is silent."""
    t, f = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(filename), F.lit(""))
    low, flow = F.lower(t), F.lower(f)
    labelled = F.filter(F.regexp_extract_all(t, F.lit(r"(?i)UIN\s*[:\-]?\s*([A-Z0-9]+)"), 1), lambda u: ~u.rlike("^X+$") & (F.length(u) > 2))
    uins = F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(f"({UIN})"), 1), labelled))
    valid = F.filter(uins, lambda u: u.rlike(f"^{UIN}$") | ((F.length(u) >= 12) & u.rlike("^[A-Z]{3,6}LIP")))
    in_text = F.coalesce(F.get(valid, F.lit(0)), F.get(uins, F.lit(0)))
    in_file = F.nullif(F.regexp_extract(f, r"([A-Z]{3,6}LIP\d+[A-Z]?\d+)", 1), F.lit(""))
    insurer = _first([(low.contains(k), v) for k, v in INSURERS])
    file_insurer = _first([(_any(flow, ks), name) for ks, name in FILE_INSURERS])
    label = F.regexp_extract(t, r"(?is)Product\s*(?:Name)?\s*[:\-]?\s*\n?\s*(.+?)(?:\n|$)", 1)
    label = strip(F.regexp_replace(F.regexp_replace(label, r"(?s)\s*[Uu][Ii][Nn]\s*.*", ""), r"(?s)\s*Product\s*.*", ""))
    label = strip(F.regexp_replace(label, "[;,]+$", ""))
    label = F.when((F.length(label) > 2) & (F.length(label) < 60) & ~label.startswith("the"), F.regexp_replace(label, r"\s+", " "))
    product = F.coalesce(_first([(low.rlike(p), v) for p, v in PRODUCTS]), label)
    plain = F.replace(F.replace(flow, F.lit("policy wordings - "), F.lit("")), F.lit(".pdf"), F.lit(""))
    all_of = lambda ks: plain.contains(ks[0]) & (plain.contains(ks[1]) if len(ks) > 1 else F.lit(True))
    file_product = F.coalesce(_first([(all_of(ks), v) for ks, v in FILE_PRODUCTS]), plain)
    kind, file_kind = _first([(low.rlike(p), v) for p, v in DOCUMENT_TYPES]), _first([(_any(flow, ks), v) for ks, v in FILE_TYPES])
    flag = lambda when, name: F.when(when, F.lit(name))
    differ = kind.isNotNull() & file_kind.isNotNull() & (kind != file_kind)
    flags = F.array_compact(
        F.array(
            flag(in_text.isNull() & in_file.isNotNull(), "uin_from_filename_not_content"),
            flag(in_text.isNull() & in_file.isNull(), "uin_not_found"),
            flag(product.isNull(), "product_from_filename"),
            flag(insurer.isNull(), "insurer_from_filename"),
            flag(differ, "document_type_mismatch_content_vs_filename"),
            flag(kind.isNull() & file_kind.isNull(), "document_type_inferred"),
            flag(differ | (kind.isNull() & file_kind.isNull()), "document_type_from_filename"),
        )
    )
    return {
        "insurer": F.coalesce(insurer, file_insurer),
        "product": F.coalesce(product, file_product),
        "uin": F.coalesce(in_text, in_file),
        "uin_low_confidence": in_text.isNotNull() & (F.size(valid) == 0),
        "document_type": F.coalesce(file_kind, kind, F.lit("Policy Wording")),
        "version": F.nullif(F.regexp_extract(t, r"\bV\.?\s*(\d{1,3})\b", 1), F.lit("")),
        "review_flags": flags,
    }


def ocr_need(chars: Column, blocks: Column, text_area: Column, images: Column, coverage: Column, n_fonts: Column) -> dict[str, Column]:
    """needs_ocr, ocr_confidence and the reasons, each judged on its own."""
    flag = lambda when, name: F.when(when, F.lit(name))
    reasons = F.array_compact(
        F.array(
            flag(chars == 0, "no_extractable_text"),
            flag((chars > 0) & (chars < 100), "very_low_text_count"),
            flag((blocks < 2) & (chars < 50), "insufficient_text_blocks"),
            flag(images > 0, "images_present"),
            flag((images > 0) & (coverage > 0.5), "high_image_coverage"),
            flag((text_area > 0) & (F.try_divide(chars.cast("double"), text_area / 1000) < 0.05), "low_text_density"),
            flag((n_fonts == 0) & (chars > 0), "no_font_info_with_text"),
        )
    )
    needs = (images > 0) & (chars < 100)
    return {
        "needs_ocr": needs,
        "ocr_confidence": F.when(~needs, "not_required").when(chars == 0, "high").when(chars < 50, "medium").otherwise("low"),
        "ocr_reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("text_extraction_ok"))),
    }
