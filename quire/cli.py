"""Command line: PDFs, one or a folder of them, to paragraphs.

One file gives one JSON file with the envelope; a folder, or an output that ends in .parquet or .jsonl, gives a table of
records. Each file is decoded once. What could not be read is named, and the exit code is then 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quire.api import session
from quire.operators import layout
from quire.plans import documents as plans
from quire.plans import output
from quire.runtime import ship
from quire.sources import download, pdf_source, pymupdf_source

TABLES = {".parquet": "parquet", ".jsonl": "json"}


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description="Paragraph records of PDF files.")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--pdf", type=Path, metavar="PATH", help="file or folder to read")
    given.add_argument("--url", metavar="ADDRESS", help="file to fetch into the working folder and read")
    p.add_argument("--keep", action="store_true", help="with --url: do not fetch what is there already")
    p.add_argument("-o", "--output", type=Path, metavar="PATH", default=Path("paragraphs.json"), help="default: %(default)s")
    p.add_argument("--indent", type=int, metavar="N", default=2, help="spaces a level in the JSON file; 0 puts it on one line")
    p.add_argument("--preview", type=int, metavar="N", default=0, help="print a summary and the first N numbered paragraphs")
    return p.parse_args(argv)


def scan(spark: SparkSession, path: Path) -> tuple[DataFrame, list[str]]:
    """Paragraphs of the readable files, and a line for each of the others."""
    glob = "*.pdf" if path.is_dir() else "*"
    if pymupdf_source.available():
        return plans.blocks_to_paragraphs(pdf_source.read_blocks(spark, str(path), glob, "pymupdf")).persist(), []
    frags = pdf_source.read_fragments(spark, str(path), glob).persist()
    failures = [f"{r.doc_id}: {r.error}" for r in pdf_source.failed(frags).toLocalIterator()]
    return plans.blocks_to_paragraphs(layout.fragments_to_blocks(frags.where("error is null"))).persist(), failures


def save(paras: DataFrame, label: str, to: Path, indent: int, many: bool) -> str:
    kind = TABLES.get(to.suffix, "json" if many else None)
    if kind is None:
        return f"{output.write_json(paras, label, to, indent)} paragraphs in {to}"
    output.write_tables(paras, str(to), kind)
    return f"table of paragraphs in {to}"


def main(argv: list[str] | None = None) -> int:
    chosen = options(argv)
    path = chosen.pdf or download.download_pdf(chosen.url, Path(download.name_for(chosen.url)), chosen.keep)
    spark = session()
    ship(spark)
    paras, failures = scan(spark, path)
    many = path.is_dir()
    if many or not failures:
        print(save(paras, chosen.url or str(path), chosen.output, chosen.indent, many), file=sys.stderr)
    if chosen.preview:
        print("\n".join(output.summary(paras, chosen.preview)))
    print(*failures, sep="\n", end="\n" if failures else "", file=sys.stderr)
    return int(bool(failures))


if __name__ == "__main__":
    raise SystemExit(main())
