"""Fetching a PDF over HTTP, on the driver, to a file that the scan then reads."""

from __future__ import annotations

import urllib.request
from pathlib import Path

USER_AGENT, TIMEOUT = "Mozilla/5.0 (X11; Linux x86_64) quire/1.0", 60


def name_for(url: str) -> str:
    return Path(url).name or "document.pdf"


def download_pdf(url: str, dest: Path, skip_existing: bool = False) -> Path:
    """Writes the file and returns its path. An HTTP error raises, and so does a body that is no PDF; nothing is written then."""
    if skip_existing and dest.exists():
        return dest
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=TIMEOUT) as answer:
        body, kind = answer.read(), answer.headers.get("content-type")
    if not body.startswith(b"%PDF"):
        raise RuntimeError(f"{url} did not answer with a PDF (content-type: {kind})")
    dest.write_bytes(body)
    return dest
