"""PDF decoding: pieces, whole files, and the way from files to JSON."""

import json

import pytest

from quire import cli
from quire.plans.output import read_json
from quire.sources import pdf_source
from quire.sources.pdf import PdfFile, page_fragments
from quire.sources.pdf.filters import apply_predictor, decode
from quire.sources.pdf.fonts import Font, parse_tounicode
from quire.sources.pdf.syntax import Name, Reader, Ref
from quire.sources.sample_pdf import write_pdf
from quire.streaming.watch import pdf_stream, write_paragraphs

PAGES = [[("1 Introduction", 14, True), ("1. The text starts here and", 10, False), ("goes on “there”.", 10, False)], [("2. Another one.", 10, False)]]


def test_cmap():
    table, wide = parse_tounicode(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0003> <0041> endbfchar beginbfrange <0010> <0012> <0061> endbfrange")
    assert wide and (table[3], table[0x10], table[0x12]) == ("A", "a", "c")
    assert parse_tounicode(b"beginbfrange <01> <02> [<0058> <D83DDE00>] endbfrange") == ({1: "X", 2: "😀"}, False)


def test_predictors():
    assert apply_predictor(bytes([0, 10, 20, 30, 2, 1, 2, 3]), 12, 1, 8, 3) == bytes([10, 20, 30, 11, 22, 33])
    assert apply_predictor(bytes([1, 1, 1, 1]), 11, 1, 8, 3) == bytes([1, 2, 3])
    assert apply_predictor(bytes([0, 10, 20, 3, 5, 5, 4, 1, 1]), 15, 1, 8, 2) == bytes([10, 20, 10, 20, 11, 21])
    assert apply_predictor(bytes([1, 2, 3, 4]), 2, 1, 8, 4) == bytes([1, 3, 6, 10])
    assert apply_predictor(b"ab", 1) == b"ab" and apply_predictor(bytes([0, 7]), 12, 1, 8, 3) == bytes([7, 0, 0])


def test_font_decoding():
    assert Font(True, {3: "A", 4: "B"}).decode(b"\0\3\0\4\0") == "AB"
    assert Font().decode(b"\x92\xe9") == "’é" and Font(True).decode(b"\0\1") == ""


def test_objects():
    read = lambda x: Reader(x).read()
    assert read(b"<< /A#20b [1 -2.5 (a\\(b\\)\\101\\\nc(d)) <414> true null 3 0 R] % x\n /B /C >>") == {"A b": [1, -2.5, b"a(b)Ac(d)", b"A@", True, None, Ref(3, 0)], "B": Name("C")}
    with pytest.raises(EOFError):
        read(b"  ")
    with pytest.raises(ValueError):
        read(b"]")


def test_filters():
    assert decode({"Filter": [Name("AHx")]}, b"41 42 4>") == b"AB@"
    assert decode({"Filter": Name("A85")}, b"<~87cUR~>") == b"Hell"
    assert decode({"Filter": [Name("DCTDecode"), Name("AHx")]}, b"41>") == b"41>"  # an unknown filter ends the chain


@pytest.mark.parametrize("packed", [False, True])
def test_written_files_are_read(packed):
    pdf = PdfFile(write_pdf(PAGES, packed))
    frags = [f for k, p in enumerate(pdf.pages(), 1) for f in page_fragments(pdf, p, k)]
    assert [(f.page, f.text, f.size, f.bold) for f in frags] == [(k, t, s, b) for k, page in enumerate(PAGES, 1) for t, s, b in page]
    assert frags[0].y_top == 842 - 760 and frags[0].x == 72


def test_text_operators():
    ops = b"BT /R 10 Tf 12 TL 2 0 0 2 100 700 Tm (a) Tj T* [(b) -250 (c) 20] TJ (d) ' 1 2 (e) \" 5 -6 TD (f) Tj 1 0 Td (g) Tj ET q 1 0 0 1 9 9 cm Q (h) Tj ) ] >"
    base = write_pdf([[("x", 10, False)]])
    pdf = PdfFile(base)
    page = pdf.pages()[0]
    pdf.content = lambda _: ops
    got = [(f.text, f.x, f.y_top, f.size) for f in page_fragments(pdf, page, 1)]
    assert got == [("a", 100, 142, 20), ("b", 100, 166, 20), (" ", 100, 0, 10), ("c", 100, 166, 20), ("d", 100, 190, 20), ("e", 100, 214, 20), ("f", 110, 226, 20), ("g", 112, 226, 20), ("h", 112, 226, 20)]


def test_damaged_files_give_error_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(write_pdf(PAGES))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    frags = pdf_source.read_fragments(spark, str(tmp_path))
    assert frags.where("error is not null").count() == 2 and frags.where("error is null").count() == 4
    assert pdf_source.not_pdf(pdf_source.read_files(spark, str(tmp_path))).count() == 1


@pytest.mark.parametrize("packed", [False, True])
def test_command_line(spark, tmp_path, packed):
    pdf, out = tmp_path / "a.pdf", tmp_path / "out.json"
    pdf.write_bytes(write_pdf(PAGES, packed))
    assert cli.main(["--pdf", str(pdf), "-o", str(out), "--indent", "0"]) == 0
    body = json.loads(out.read_text())
    assert out.read_text().endswith("}\n") and out.read_text().count("\n") == 1
    assert [(p["id"], p["paragraph_number"], p["chapter"], p["section"], p["page_start"], p["page_end"], p["text"]) for p in body["paragraphs"]] == [
        (1, "1", "1 Introduction", None, 1, 1, "1. The text starts here and goes on “there”."),
        (2, "2", "1 Introduction", None, 2, 2, "2. Another one."),
    ]
    assert read_json(spark, str(out)).count() == body["paragraph_count"] == 2


def test_command_line_over_a_folder(spark, tmp_path, capsys):
    folder, out = tmp_path / "in", tmp_path / "out.parquet"
    folder.mkdir()
    for name, packed in (("a.pdf", False), ("b.pdf", True)):
        (folder / name).write_bytes(write_pdf(PAGES, packed))
    (folder / "c.pdf").write_bytes(b"%PDF-1.4 cut off")
    assert cli.main(["--pdf", str(folder), "-o", str(out), "--preview", "1"]) == 1  # one file cannot be read
    said = capsys.readouterr()
    assert spark.read.parquet(str(out)).count() == 4 and "c.pdf: " in said.err
    assert said.out.splitlines()[0] == "2 documents, 4 paragraphs, 4 of them numbered" and len(said.out.splitlines()) == 2


def test_an_unreadable_file_writes_nothing(spark, tmp_path, capsys):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 cut off")
    assert cli.main(["--pdf", str(tmp_path / "x.pdf"), "-o", str(tmp_path / "x.json")]) == 1
    assert not (tmp_path / "x.json").exists() and "x.pdf: " in capsys.readouterr().err


def test_stream_of_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(write_pdf(PAGES))
    run = lambda: write_paragraphs(pdf_stream(spark, str(folder)), str(out), str(tmp_path / "state")).awaitTermination(120)
    run()
    (folder / "b.pdf").write_bytes(write_pdf(PAGES, True))
    run()
    assert spark.read.parquet(f"{out}/paragraphs").groupBy("batch").count().count() == 2
