"""Optional outside libraries and services, as Arrow functions. Each import
happens on the executors, in the function that needs it."""

from __future__ import annotations

import importlib.util
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.ingest import ocr_boxes

BLOCKS = "document_id string, page_number int, block_id string, text string, bbox array<double>, font_name string, font_size double, is_bold boolean, is_italic boolean, page_width double, page_height double, image_count int"


def pdf_available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def ocr_engine() -> str | None:
    """The first OCR library that is there."""
    return next((n for n in ("easyocr", "pytesseract") if importlib.util.find_spec(n)), None)


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of PDF files (path, content), page by page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                out = []
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        images = len(page.get_images())
                        for b in page.get_text("dict")["blocks"]:
                            spans = [s for line in b.get("lines", []) for s in line["spans"]]
                            text = "".join(s["text"] for s in spans)
                            if text.strip():
                                flags = [s["flags"] for s in spans]
                                out.append((path, n, f"p{n}_b{len(out)}", text, list(b["bbox"]), spans[0]["font"], max(s["size"] for s in spans), any(x & 16 for x in flags), any(x & 2 for x in flags), page.rect.width, page.rect.height, images))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


#: What an engine finds on an image: (text, confidence, box in pixels) each.
Reader = Callable[[bytes], list[tuple[str, float | None, list[float]]]]


def page_images(files: DataFrame, dpi: int = 300) -> DataFrame:
    """(document_id, page_number, content, page_width, page_height): the pages
    of PDF files (path, content) as PNG images."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        png = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), alpha=False).tobytes("png")
                        yield pd.DataFrame([(path, n, png, page.rect.width, page.rect.height)], columns=["document_id", "page_number", "content", "page_width", "page_height"])

    return files.select("path", "content").mapInPandas(run, "document_id string, page_number int, content binary, page_width double, page_height double")


def reader_of(engine: str, language: str = "en") -> Reader:
    """The named OCR library as a reader; a worker loads it once."""
    loaded: list = []

    def by_easyocr(image: bytes) -> list:
        import easyocr

        if not loaded:
            loaded.append(easyocr.Reader([language], gpu=False))
        found = loaded[0].readtext(image, paragraph=False, detail=1)
        return [(t, float(c), [min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)]) for p, t, c in found]

    def by_tesseract(image: bytes) -> list:
        import io

        import pytesseract
        from PIL import Image

        d = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=language, output_type=pytesseract.Output.DICT)
        return [(t, c / 100 if c >= 0 else None, [x, y, x + w, y + h]) for t, c, x, y, w, h in zip(d["text"], map(float, d["conf"]), d["left"], d["top"], d["width"], d["height"], strict=True)]

    readers = {"easyocr": by_easyocr, "pytesseract": by_tesseract}
    if engine not in readers:
        raise ValueError(f"unknown OCR engine: {engine}")
    return readers[engine]


def ocr_pages(images: DataFrame, read: Reader) -> DataFrame:
    """(document_id, page_number, text, confidence, bbox, error) of page images
    (document_id, page_number, content), a row a text found, in order; an image
    that can't be read gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, p, x in zip(f["document_id"], f["page_number"], f["content"], strict=True):
                try:
                    found = [(t, c, [float(v) for v in b]) for t, c, b in read(x) if t and t.strip()]
                except Exception as e:  # one bad page must not stop the others
                    rows.append((d, p, 0, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(d, p, n, *r, None) for n, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "n", "text", "confidence", "bbox", "error"])

    return images.select("document_id", "page_number", "content").mapInPandas(run, "document_id string, page_number int, n int, text string, confidence double, bbox array<double>, error string")


def ocr_scan(images: DataFrame, read: Reader, dpi: int = 300) -> tuple[DataFrame, DataFrame]:
    """Blocks (boxes in points, within the page) and pages (document_id,
    page_number, ocr_used, ocr_text, mean and least confidence, error) of
    page_images()."""
    sizes = images.select("document_id", "page_number", "page_width", "page_height")
    found = ocr_pages(images, read).join(sizes, ["document_id", "page_number"])
    good = found.where("error is null")
    blocks = ocr_boxes(good, dpi).withColumn("bbox", F.transform("bbox", lambda v: F.round(v, 2))).withColumn("confidence", F.round("confidence", 4))
    blocks = blocks.withColumn("block_id", F.format_string("p%d_ocr_b%d", "page_number", "n")).withColumn("source", F.lit("ocr")).drop("error")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("n", "text")))), lambda x: x["text"]), "\n")
    per = found.groupBy("document_id", "page_number").agg(texts.alias("ocr_text"), F.round(F.avg("confidence"), 4).alias("ocr_confidence_mean"), F.round(F.min("confidence"), 4).alias("ocr_confidence_min"), F.max("error").alias("error"))
    pages = sizes.select("document_id", "page_number").join(per, ["document_id", "page_number"], "left").withColumn("ocr_used", F.col("error").isNull())
    for c in ("ocr_confidence_mean", "ocr_confidence_min"):
        pages = pages.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return blocks, pages.withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "context_text", batch: int = 64) -> DataFrame:
    """rows with `embedding`: unit vectors of a model, batch by batch."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        import numpy as np

        out: list = []
        for i in range(0, len(texts), batch):
            v = np.asarray(model(texts.iloc[i : i + batch].fillna("").tolist()), np.float64)
            out += list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
        return pd.Series(out)

    return rows.withColumn("embedding", vectors(F.col(text_col)))


def service_ready(host: str, timeout: float = 5.0) -> bool:
    """Whether a text service answers."""
    try:
        with urllib.request.urlopen(f"{host}/api/tags", timeout=timeout) as r:
            return r.status == 200
    except (OSError, ValueError):
        return False


def _call(host: str, body: dict, timeout: float) -> tuple[str | None, str | None, dict[str, int]]:
    """(answer, error, use) of one request."""
    try:
        request = urllib.request.Request(f"{host}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            got = json.loads(r.read())
    except urllib.error.HTTPError as e:
        return None, f"http {e.code}", {}
    except TimeoutError:
        return None, "timeout", {}
    except (OSError, ValueError) as e:
        return None, f"unreachable: {e}", {}
    if got.get("error"):
        return None, f"service: {got['error']}", {}
    use = {"calls": 1, "prompt_tokens": int(got.get("prompt_eval_count") or 0), "completion_tokens": int(got.get("eval_count") or 0)}
    return (got.get("response") or "").strip(), None, use


def service_calls(prompts: DataFrame, host: str, model: str, system: str | None = None, options: dict | None = None, timeout: float = 120.0) -> DataFrame:
    """(query_id, answer, error, usage) of prompts (query_id, prompt), not
    streamed; a call that fails says how and is no use."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            body = {"model": model, "stream": False, "options": options or {}} | ({"system": system} if system else {})
            yield pd.DataFrame([(q, *_call(host, body | {"prompt": p}, timeout)) for q, p in zip(f["query_id"], f["prompt"], strict=True)], columns=["query_id", "answer", "error", "usage"])

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, answer string, error string, usage map<string,bigint>")


def text_service(host: str, model: str, timeout: float = 120.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A model for operators.answer.by_model(): posts each prompt and takes the
    response; a failure gives null, and so the refusal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [_call(host, {"model": model, "prompt": p, "stream": False}, timeout)[0] for p in f["prompt"]]})

    return run
