"""Schemas of the engine's tables, as DDL for explicit reads."""

TABLE_INFO = "struct<bbox:array<double>,text:string,source:string>"
BLOCK = (
    "page_number int, block_id string, reading_order int, type string, subtype string, text string, raw_text string, "
    "normalized_text string, bbox array<double>, font_name string, font_size double, is_bold boolean, is_italic boolean, "
    "is_upper boolean, source string, ocr_used boolean, char_count int, word_count int, heading_level int, "
    "clause_number string, clause_id string, confidence double, classification_confidence double, is_repeated boolean, "
    f"include_in_chunk_text boolean, has_unicode_issues boolean, table_info {TABLE_INFO}"
)
BLOCKS = f"document_id string, {BLOCK}"


def _as_struct(ddl: str) -> str:
    """A column list as struct fields."""
    out, depth, item = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, _, kind = item.strip().partition(" ")
            out.append(f"{name}:{kind}")
            item = ""
        else:
            item += ch
    return f"struct<{','.join(out)}>"


PAGE = f"page_number int, page_width double, page_height double, char_count int, word_count int, ocr_used boolean, layout_type string, blocks array<{_as_struct(BLOCK)}>"
METADATA = "insurer string, product string, uin string, document_type string"
DOCUMENT = (
    f"document_id string, filename string, source_path string, {METADATA}, metadata {_as_struct(METADATA)}, pages array<{_as_struct(PAGE)}>"
)
CHUNKS = (
    "chunk_id string, document_id string, text string, context_text string, page_start int, page_end int, section string, "
    "subsection string, clause_ids array<string>, chunk_type string, char_count int, word_count int, filename string, "
    "insurer string, product string, uin string, document_type string, source_path string, embedding_model string"
)
REGISTRY = (
    "document_id string, filename string, source_path string, insurer string, product string, uin string, document_type string, "
    "version string, checksum string, page_count int, status string, duplicate_of string, ingested_at string, review_flags array<string>"
)
EVAL_QUERY = "id string, qid string, query string, category string, relevant_chunk_ids array<string>, notes string"
OCR_BLOCK = "page_number int, text string, bbox array<double>, confidence double, block_id string, source string, engine string"
OCR_PAGE = f"page_number int, ocr_used boolean, ocr_engine string, ocr_confidence_mean double, ocr_confidence_min double, ocr_text string, blocks array<{_as_struct(OCR_BLOCK)}>"
OCR_DOCUMENT = f"document_id string, filename string, engine string, total_pages int, ocr_pages array<{_as_struct(OCR_PAGE)}>"
REQUEST_LOG = "ts timestamp, path string, query string, status int, latency_ms map<string,double>, usage map<string,bigint>"
CHECKPOINT = (
    "label string, qid string, query string, category string, answerable boolean, query_type string, abstained boolean, "
    "clarification string, evidence_chunk_ids array<string>, retrieval_top_chunk_ids array<string>, relevant_chunk_ids array<string>, "
    "claims int, supported int, contradicted int, insufficient int, unresolved_citations int, unsupported_stripped int, "
    "contradicted_kept int, evidence_products array<string>, degenerate boolean, plan_empty boolean, final_answer string, "
    "supported_rate double, latency_ms map<string,double>, usage map<string,bigint>, answered_with_relevant_evidence boolean"
)
