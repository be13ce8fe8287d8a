"""Positioned text of PDF files: tokens (page, ord, str, x, y, w, h) for the layout operators.

A reader of its own for what books use: objects found by scanning (so broken tables of contents don't matter), object
streams, Flate streams with PNG predictors, the page tree, text operators with their matrices, simple fonts with widths,
composite fonts with ToUnicode maps. Encrypted files and pages without text (scans as images) give no token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(rb"(?P<str>\()|(?P<hexa><[0-9A-Fa-f\s]*>)|(?P<open><<|\[)|(?P<close>>>|\])|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)|%[^\r\n]*")
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Name(str):
    """A PDF name."""


class Ref(int):
    """A reference to an object."""


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket opens before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            e = data[at]
            at += 1
            if 0x30 <= e < 0x38:
                m = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])
                out.append(int(m[0], 8) & 255)
                at += len(m[0]) - 1
            elif e not in (10, 13):
                out.append(ESCAPES.get(e, e))
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def parse(data: bytes, at: int = 0, one: bool = False) -> Iterator[object]:
    """The values in ``data`` in order: numbers, names, strings, lists, dictionaries, references, words."""
    stack: list[list] = [[]]
    while (m := TOKEN.search(data, at)) is not None:
        at, kind = m.end(), m.lastgroup
        if kind == "str":
            value, at = _string(data, at)
        elif kind == "hexa":
            digits = re.sub(rb"\s", b"", m[0][1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m["name"].decode("latin-1")))
        elif kind == "num":
            value = float(m[0]) if b"." in m[0] else int(m[0])
        elif kind == "open":
            stack.append([])
            continue
        elif kind == "close":
            if len(stack) == 1:
                continue
            held = stack.pop()
            value = held if m[0] == b"]" else dict(zip(held[::2], held[1::2]))
        elif kind == "word":
            w = m[0].decode("latin-1")
            if w == "R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
                _, number = stack[-1].pop(), stack[-1].pop()
                value = Ref(number)
            else:
                value = {"true": True, "false": False, "null": None}.get(w, Word(w))
        else:
            continue
        stack[-1].append(value)
        if len(stack) == 1:
            if one and (not isinstance(value, int) or len(stack[0]) > 3):
                yield stack[0][0]
                return
            if not one:
                yield value
                stack[0] = stack[0][-2:]
    if one and stack[0]:
        yield stack[0][0]


def _unpredicted(data: bytes, columns: int, size: int) -> bytes:
    """Rows that were stored as differences (PNG predictors)."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            a, b, c = (row[i - size] if i >= size else 0), above[i], (above[i - size] if i >= size else 0)
            if kind == 1:
                row[i] = (row[i] + a) & 255
            elif kind == 2:
                row[i] = (row[i] + b) & 255
            elif kind == 3:
                row[i] = (row[i] + (a + b) // 2) & 255
            elif kind == 4:
                p = a + b - c
                row[i] = (row[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
        out += row
        above = bytes(row) + bytes(columns - len(row))
    return bytes(out)


class Document:
    """The objects of a file by number."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        marks = list(OBJECT.finditer(data))
        for m, stop in zip(marks, [x.start() for x in marks[1:]] + [len(data)]):
            body = data[m.end() : stop]
            begin = re.search(rb"stream\r?\n", body)
            head = body[: begin.start()] if begin else body
            self.objects[int(m[1])] = next(parse(head.split(b"endobj")[0], one=True), None)
            if begin:
                self.streams[int(m[1])] = body[begin.end() : max(body.rfind(b"endstream"), begin.end())]
        self.encrypted = b"/Encrypt" in data[-4096:] or any(isinstance(o, dict) and o.get("Type") == "XRef" and "Encrypt" in o for o in self.objects.values())
        for n in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            raw, first = self.stream(n), self.objects[n].get("First", 0)
            numbers = [int(x) for x in raw[:first].split() if x.isdigit()]
            for number, offset in zip(numbers[::2], numbers[1::2]):
                self.objects.setdefault(number, next(parse(raw[first + offset :], one=True), None))

    def get(self, value: object) -> object:
        """What a value stands for."""
        for _ in range(16):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        """The bytes of a stream, decoded; none for filters that are not known."""
        head, raw = self.objects.get(number), self.streams.get(number, b"")
        length = self.get(head.get("Length")) if isinstance(head, dict) else None
        if isinstance(length, int) and 0 < length <= len(raw):
            raw = raw[:length]
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        params = self.get(head.get("DecodeParms")) if isinstance(head, dict) else None
        for k, f in enumerate(filters if isinstance(filters, list) else [filters] if filters else []):
            if self.get(f) not in ("FlateDecode", "Fl"):
                return b""
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return b""
            p = self.get(params[k]) if isinstance(params, list) else params
            if isinstance(p, dict) and p.get("Predictor", 1) >= 10:
                size = max(1, p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
                raw = _unpredicted(raw, p.get("Columns", 1) * size, size)
        return raw

    def pages(self) -> list[dict]:
        """The pages in order, each with the resources it inherits."""
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        out: list[dict] = []
        seen: set[int] = set()

        def walk(node: object, inherited: object) -> None:
            if isinstance(node, Ref):
                if int(node) in seen:
                    return
                seen.add(int(node))
            d = self.get(node)
            if not isinstance(d, dict):
                return
            resources = d.get("Resources", inherited)
            if "Kids" in d:
                for kid in self.get(d["Kids"]) or []:
                    walk(kid, resources)
            elif d.get("Type") == "Page" or "Contents" in d:
                out.append({**d, "Resources": resources})

        for root in roots[-1:]:
            walk(root.get("Pages"), None)
        return out


class Font:
    """How the codes of a font are read: their text and their widths in thousandths."""

    def __init__(self, doc: Document, spec: dict) -> None:
        self.two = spec.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.usual = 500.0
        if isinstance(spec.get("ToUnicode"), Ref):
            self._read_map(doc.stream(int(spec["ToUnicode"])))
        if self.two:
            inner = doc.get((doc.get(spec.get("DescendantFonts")) or [None])[0]) or {}
            self.usual = float(doc.get(inner.get("DW", 1000)) or 1000)
            w = doc.get(inner.get("W")) or []
            i = 0
            while i + 1 < len(w):
                first, nxt = doc.get(w[i]), doc.get(w[i + 1])
                if isinstance(nxt, list):
                    self.widths |= {first + k: float(doc.get(x)) for k, x in enumerate(nxt)}
                    i += 2
                else:
                    self.widths |= dict.fromkeys(range(first, min(nxt, first + 65536) + 1), float(doc.get(w[i + 2])))
                    i += 3
        else:
            start = doc.get(spec.get("FirstChar", 0)) or 0
            self.widths = {start + k: float(doc.get(x) or 0) for k, x in enumerate(doc.get(spec.get("Widths")) or [])}

    def _read_map(self, data: bytes) -> None:
        number = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "replace")
        values: list = []
        for v in parse(data):
            if not isinstance(v, Word):
                values.append(v)
                continue
            if v == "endbfchar":
                self.map |= {number(a): text(b) for a, b in zip(values[::2], values[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif v == "endbfrange":
                for a, b, c in zip(values[::3], values[1::3], values[2::3]):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    for k in range(min(number(b) - number(a), 65535) + 1):
                        if isinstance(c, list) and k < len(c):
                            self.map[number(a) + k] = text(c[k])
                        elif isinstance(c, bytes) and len(c) >= 2:
                            self.map[number(a) + k] = text(c[:-2] + ((number(c[-2:]) + k) & 0xFFFF).to_bytes(2, "big"))
            values = []

    def read(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(text, width, whether it is a one-byte blank) of each code."""
        codes = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] if self.two else list(raw)
        plain = lambda c: chr(c) if self.two else bytes([c]).decode("cp1252", "replace")
        return [(self.map[c] if c in self.map else plain(c), self.widths.get(c, self.usual) / 1000, not self.two and c == 32) for c in codes]


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def _times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def page_tokens(doc: Document, page: dict) -> list[tuple[str, float, float, float, float]]:
    """(text, x, y, width, size) of every string the page shows."""
    resources = doc.get(page.get("Resources")) or {}
    specs = doc.get(resources.get("Font")) or {}
    fonts: dict[str, Font] = {}
    contents = doc.get(page.get("Contents")) if not (isinstance(page.get("Contents"), Ref) and int(page["Contents"]) in doc.streams) else [page["Contents"]]
    data = b"\n".join(doc.stream(int(c)) for c in (contents or []) if isinstance(c, Ref))
    out: list[tuple[str, float, float, float, float]] = []
    ctm, saved, tm, line = UNIT, [], UNIT, UNIT
    font, size, leading, scale, rise, chars, words = None, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0
    args: list = []

    def show(raw: bytes) -> None:
        nonlocal tm
        if font is None:
            return
        start, text, width = _times((1, 0, 0, 1, 0, rise), _times(tm, ctm)), "", 0.0
        for t, w, blank in font.read(raw):
            text += t
            width += (w * size + chars + (words if blank else 0)) * scale
        tm = _times((1, 0, 0, 1, width, 0), tm)
        end = _times(tm, ctm)
        if text.strip():
            out.append((text, start[4], start[5], abs(end[4] - start[4]), abs(size) * (start[2] ** 2 + start[3] ** 2) ** 0.5))

    def down(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = _times((1, 0, 0, 1, x, y), line)

    for v in parse(data):
        if not isinstance(v, Word):
            args.append(v)
            continue
        a, args = args, []
        try:
            if v == "q":
                saved.append(ctm)
            elif v == "Q":
                ctm = saved.pop() if saved else UNIT
            elif v == "cm":
                ctm = _times(tuple(map(float, a[-6:])), ctm)
            elif v == "BT":
                tm = line = UNIT
            elif v == "Tf":
                name, size = str(a[-2]), float(a[-1])
                if name not in fonts:
                    fonts[name] = Font(doc, doc.get(specs.get(name)) or {})
                font = fonts[name]
            elif v in ("Td", "TD"):
                leading = -float(a[-1]) if v == "TD" else leading
                down(float(a[-2]), float(a[-1]))
            elif v == "Tm":
                tm = line = tuple(map(float, a[-6:]))
            elif v == "T*":
                down(0, -leading)
            elif v == "TL":
                leading = float(a[-1])
            elif v == "Tc":
                chars = float(a[-1])
            elif v == "Tw":
                words = float(a[-1])
            elif v == "Tz":
                scale = float(a[-1]) / 100
            elif v == "Ts":
                rise = float(a[-1])
            elif v == "Tj":
                show(a[-1])
            elif v in ("'", '"'):
                if v == '"':
                    words, chars = float(a[-3]), float(a[-2])
                down(0, -leading)
                show(a[-1])
            elif v == "TJ":
                for x in a[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        tm = _times((1, 0, 0, 1, -float(x) / 1000 * size * scale, 0), tm)
        except (IndexError, TypeError, ValueError):
            continue
    return out


def pdf_pages(data: bytes) -> list[list[tuple[str, float, float, float, float]]]:
    """The tokens of each page; none for encrypted files and other formats."""
    if b"%PDF" not in data[:1024]:
        return []
    doc = Document(data)
    return [] if doc.encrypted else [page_tokens(doc, p) for p in doc.pages()]


def tokens(files: DataFrame) -> DataFrame:
    """(book_id, page, ord, str, x, y, w, h) of PDF files (path, content); ``book_id`` is the path."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [(path, n, k, *t) for n, page in enumerate(pdf_pages(bytes(content))) for k, t in enumerate(page)]
                yield pd.DataFrame(rows, columns=["book_id", "page", "ord", "str", "x", "y", "w", "h"])

    return files.where(F.lower("path").endswith(".pdf")).select("path", "content").mapInPandas(run, "book_id string, page int, ord int, str string, x double, y double, w double, h double")


def scanned(files: DataFrame, least: int = 20) -> DataFrame:
    """(book_id): PDF files with fewer than ``least`` characters of text in all, which are images of pages."""
    size = tokens(files).groupBy("book_id").agg(F.sum(F.length("str")).alias("n"))
    return files.where(F.lower("path").endswith(".pdf")).select(F.col("path").alias("book_id")).join(size, "book_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("book_id")
