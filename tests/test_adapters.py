"""Adapters against stand-ins for the libraries and services they call."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagemill.operators import ingest
from pagemill.sources import adapters

FITZ = '''
class Matrix:
    def __init__(self, a, b): self.a = a
class Rect:
    width, height = 600.0, 800.0
class Pix:
    def __init__(self, page, m): self.page, self.m = page, m
    def tobytes(self, kind): return f"{self.page.n}@{self.m.a:.2f}".encode()
class Page:
    rect = Rect()
    def __init__(self, n): self.n = n
    def get_images(self): return [1] * (self.n - 1)
    def get_pixmap(self, matrix, alpha): return Pix(self, matrix)
    def get_text(self, kind):
        span = lambda t, size, flags: {"text": t, "size": size, "flags": flags, "font": "F" + str(flags)}
        return {"blocks": [{"bbox": (1, 2, 3, 4), "lines": [{"spans": [span("Head", 18.0, 16), span("ing", 12.0, 0)]}]}, {"bbox": (0, 0, 0, 0), "lines": [{"spans": [span("  ", 9.0, 0)]}]}, {"bbox": (5, 6, 7, 8)}]}
class Doc(list):
    def __enter__(self): return self
    def __exit__(self, *a): pass
def open(stream, filetype):
    return Doc(Page(i + 1) for i in range(len(stream)))
'''
EASY = '''
class Reader:
    def __init__(self, languages, gpu): pass
    def readtext(self, image, paragraph, detail):
        if image.startswith(b"2"):
            raise ValueError("unreadable")
        return [([[0, 0], [300, 0], [300, 300], [0, 300]], "one", 0.9), ([[0, 0], [9000, 0], [9000, 30], [0, 30]], "two", 0.5), ([[0, 0], [1, 0], [1, 1], [0, 1]], "  ", 0.1)]
'''


@pytest.fixture(scope="module")
def fakes(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fakes")
    for name, code in (("fitz", FITZ), ("easyocr", EASY)):
        (d / f"{name}.py").write_text(code)
        spark.sparkContext.addPyFile(str(d / f"{name}.py"))
    yield
    for name in ("fitz", "easyocr"):
        sys.modules.pop(name, None)


def test_pdf_blocks_and_ocr(spark, fakes):
    files = spark.createDataFrame([("/a.pdf", bytearray(b"xx")), ("/b.pdf", bytearray(b"x"))], "path string, content binary")
    got = sorted(adapters.pdf_blocks(files).collect(), key=lambda r: (r.document_id, r.page_number))
    assert [(r.document_id, r.page_number, r.text, r.font_size, r.is_bold, r.image_count) for r in got] == [("/a.pdf", 1, "Heading", 18.0, True, 0), ("/a.pdf", 2, "Heading", 18.0, True, 1), ("/b.pdf", 1, "Heading", 18.0, True, 0)]
    images = adapters.page_images(files, 144)
    assert {(r.document_id, r.page_number): bytes(r.content) for r in images.collect()}["/a.pdf", 2] == b"2@2.00"
    blocks, pages = adapters.ocr_scan(images, adapters.reader_of("easyocr"), 144)
    by = {(r.document_id, r.page_number): r for r in pages.collect()}
    assert by["/a.pdf", 1].ocr_text == "one\ntwo" and by["/a.pdf", 1].ocr_confidence_mean == 0.7 and by["/a.pdf", 1].ocr_confidence_min == 0.5
    assert not by["/a.pdf", 2].ocr_used and "unreadable" in by["/a.pdf", 2].error and by["/a.pdf", 2].ocr_text == ""
    boxes = {(r.document_id, r.n): r for r in blocks.where("page_number = 1").collect()}
    assert boxes["/a.pdf", 0].bbox == [0.0, 0.0, 150.0, 150.0] and boxes["/a.pdf", 1].bbox == [0.0, 0.0, 600.0, 15.0] and boxes["/b.pdf", 1].block_id == "p1_ocr_b1"
    native = adapters.pdf_blocks(files)
    both = ingest.with_ocr(native.withColumn("reading_order", native.page_number * 0), pages)
    assert both.where("ocr_used").count() == 2
    with pytest.raises(ValueError):
        adapters.reader_of("none")


class Service(BaseHTTPRequestHandler):
    def _send(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):  # noqa: N802
        self._send(200, {})

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if asked["prompt"] == "bad":
            self._send(500, {})
        elif asked["prompt"] == "odd":
            self._send(200, {"error": "no model"})
        else:
            self._send(200, {"response": f" {asked['model']}:{asked['prompt']} ", "prompt_eval_count": 3, "eval_count": 2})

    def log_message(self, *a):
        pass


def test_text_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    try:
        assert adapters.service_ready(host) and not adapters.service_ready("http://127.0.0.1:9")
        prompts = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, "odd")], "query_id long, prompt string")
        got = {r.query_id: r for r in adapters.service_calls(prompts, host, "m").collect()}
        assert got[1].answer == "m:hi" and got[1].usage == {"calls": 1, "prompt_tokens": 3, "completion_tokens": 2} and got[1].error is None
        assert got[2].error == "http 500" and got[3].error == "service: no model" and got[2].answer is None
        plain = prompts.withColumnRenamed("query_id", "query_id").mapInPandas(adapters.text_service(host, "m"), "query_id long, answer string")
        assert {r.query_id: r.answer for r in plain.collect()} == {1: "m:hi", 2: None, 3: None}
    finally:
        server.shutdown()
    down = adapters.service_calls(spark.createDataFrame([(1, "x")], "query_id long, prompt string"), "http://127.0.0.1:9", "m", timeout=2).first()
    assert down.error.startswith("unreachable")
