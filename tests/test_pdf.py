"""PDF files written here by hand and read back."""

import zlib

import pytest

from quillmill.operators import layout as Y
from quillmill.sources import pdf as D

LINES = ["The first line of (a) page", "goes on here.", "", "A second paragraph\\ends."]


def made(compress: bool, composite: bool = False, packed: bool = False) -> bytes:
    esc = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    if composite:
        show = lambda t: "<" + "".join(f"{ord(c):04x}" for c in t) + "> Tj"
    else:
        show = lambda t: f"({esc(t)}) Tj"
    content = ("BT /F1 10 Tf 14 TL 50 700 Td " + " T* ".join(show(t) for t in LINES) + " ET").encode("latin-1")
    cmap = b"1 beginbfrange <0020> <007e> <0020> endbfrange"
    font = "<< /Type /Font /Subtype /Type0 /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>" if composite else f"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [{' '.join(['500'] * 95)}] >>"
    flat = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 5: font, 7: "<< /Type /Font /DW 500 >>"}
    streams = {4: content, 8: cmap}
    out = b"%PDF-1.7\n"
    if packed:
        body, at = b"", []
        for n, t in flat.items():
            at.append(f"{n} {len(body)}")
            body += t.encode() + b" "
        head = (" ".join(at) + " ").encode()
        raw = zlib.compress(head + body)
        out += f"9 0 obj << /Type /ObjStm /N {len(flat)} /First {len(head)} /Filter /FlateDecode /Length {len(raw)} >> stream\n".encode() + raw + b"\nendstream endobj\n"
    else:
        for n, t in flat.items():
            out += f"{n} 0 obj {t} endobj\n".encode()
    for n, data in streams.items():
        raw = zlib.compress(data) if compress else data
        out += f"{n} 0 obj << /Length {len(raw)} {'/Filter /FlateDecode' if compress else ''} >> stream\n".encode() + raw + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("kind", [(False,), (True,), (True, True), (True, False, True), (True, True, True)])
def test_tokens_of_a_page(kind):
    (page,) = D.pdf_pages(made(*kind))
    assert [t[0] for t in page] == [x for x in LINES if x]
    assert [t[2] for t in page] == [700, 686, 658] and all(t[1] == 50 and t[4] == 10 for t in page)
    assert page[1][3] == pytest.approx(len(LINES[1]) * 5)


def test_files_to_lines(spark):
    rows = [("a.pdf", made(True)), ("b.PDF", b"%PDF-1.4 nothing"), ("c.pdf", b"no pdf"), ("d.txt", b"text"), ("e.pdf", made(True) + b" /Encrypt 1 0 R")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = [r.text for r in Y.lines(D.tokens(files)).orderBy("page", "line").collect()]
    assert got == [x for x in LINES if x]
    assert {r.book_id for r in D.scanned(files).collect()} == {"b.PDF", "c.pdf", "e.pdf"}


def test_predictors():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 22, 33, 44])]
    up = b"\x02" + rows[0] + b"\x02" + bytes((b - a) & 255 for a, b in zip(rows[0], rows[1]))
    sub = b"".join(b"\x01" + bytes([r[0], *((r[i] - r[i - 1]) & 255 for i in range(1, 4))]) for r in rows)
    assert D._unpredicted(up, 4, 1) == D._unpredicted(sub, 4, 1) == b"".join(rows)
