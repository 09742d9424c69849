"""Decoding of PDF bytes to positioned text fragments; plain Python, one file at a time."""

from .content import page_fragments
from .file import PdfFile

__all__ = ["PdfFile", "page_fragments"]
