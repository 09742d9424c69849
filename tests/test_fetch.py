"""Fetching over HTTP, file names, and the pages of the optional back-end by stand-ins."""

import http.server
import threading
from types import SimpleNamespace

import pytest

from quire.sources import download, pymupdf_source
from quire.sources.sample_pdf import write_pdf

BODY = write_pdf([[("Fetched.", 10, False)]])


@pytest.fixture
def site():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.server.asked.append((self.path, self.headers["User-Agent"]))
            self.send_response(404 if self.path == "/none.pdf" else 200)
            self.send_header("Content-Type", "text/html" if self.path == "/page" else "application/pdf")
            self.end_headers()
            self.wfile.write(b"<html>" if self.path == "/page" else BODY)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    server.asked = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_pdf_is_fetched_once(site, tmp_path):
    server, at = site
    to = tmp_path / "a.pdf"
    assert download.download_pdf(f"{at}/a.pdf", to).read_bytes() == BODY
    download.download_pdf(f"{at}/a.pdf", to, skip_existing=True)
    assert server.asked == [("/a.pdf", download.USER_AGENT)]


@pytest.mark.parametrize("path, error", [("/page", RuntimeError), ("/none.pdf", OSError)])
def test_what_is_no_pdf_is_not_written(site, tmp_path, path, error):
    with pytest.raises(error):
        download.download_pdf(site[1] + path, tmp_path / "a.pdf")
    assert not (tmp_path / "a.pdf").exists()


def test_names_of_fetched_files():
    assert [download.name_for(x) for x in ("https://x.example/d/a.en.pdf", "https://x.example/d/", "")] == ["a.en.pdf", "d", "document.pdf"]


def _span(text, size, flags=0):
    return {"text": text, "size": size, "flags": flags}


def test_blocks_of_the_optional_library(spark):
    words = [[_span("Bold ", 12.04, 16), _span(" ", 3)], [_span("hea-", 12.0, 16)], [_span("ding", 9.0)]]
    blocks = [
        {"type": 0, "bbox": (0, 50.5, 9, 9), "lines": [{"spans": x} for x in words]},
        {"type": 1, "bbox": (0, 0, 0, 0)},
        {"type": 0, "bbox": (0, 0, 0, 0), "lines": [{"spans": [_span("  ", 9)]}]},
    ]
    page = SimpleNamespace(get_text=lambda kind: {"blocks": blocks}, rect=SimpleNamespace(height=700.0))
    rows = [r for number in (1, 2) for r in pymupdf_source.page_blocks("a.pdf", number, page)]
    found = pymupdf_source.blocks_of(spark.createDataFrame(rows, pymupdf_source.RAW)).orderBy("idx")
    got = [tuple(r) for r in found.select("doc_id", "idx", "page", "text", "font_size", "bold", "y0", "page_height").collect()]
    assert got == [("a.pdf", k, k, "Bold heading", 12.0, True, 50.5, 700.0) for k in (1, 2)]
