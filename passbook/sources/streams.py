"""Positioned words from the content streams of PDF files: a small engine for ``tokens.extract`` that needs no library.

It knows what statements use: pages by the page tree, contents and forms by
reference, packed streams, text placed by matrices. Widths of letters are not read: a
word is 5.5 points a letter wide, and as high as its font (10 where none is set).
Coordinates are in points from the page's upper left corner.

Encrypted files and those with packed object tables give nothing here; any other
engine can take their place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, HEIGHT, PAGE = 5.5, 10.0, (0.0, 0.0, 595.0, 842.0)
Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_WORD = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|[\[\]]|[^\s/\[\]()<>]+", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def literal(word: bytes) -> str:
    """Text of a string operand, in brackets or hexadecimal."""
    if word[:1] == b"<":
        digits = re.sub(rb"\s", b"", word[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def plain(m: re.Match) -> bytes:
        s = m[1]
        return bytes([int(s, 8) & 255]) if s[:1].isdigit() else b"" if s[-1:] == b"\n" else _LETTERS.get(s, s)

    return _ESCAPE.sub(plain, word[1:-1]).decode("latin-1")


class File:
    """Objects of one file by number: their dictionary, and their stream unpacked."""

    def __init__(self, content: bytes) -> None:
        self.heads: dict[int, bytes] = {}
        self.bodies: dict[int, bytes] = {}
        for m in _OBJECT.finditer(content):
            packed = _STREAM.match(m[2])
            self.heads[int(m[1])] = packed[1] if packed else m[2]
            if packed:
                try:
                    self.bodies[int(m[1])] = zlib.decompress(packed[2]) if b"/FlateDecode" in packed[1] else packed[2]
                except zlib.error:
                    self.bodies[int(m[1])] = b""

    def refs(self, head: bytes, name: bytes) -> list[int]:
        """Numbers of the objects that an entry refers to, one or a list."""
        m = re.search(rb"/" + name + rb"\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", head)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2] or b"")] if m else []

    def inner(self, head: bytes, name: bytes) -> bytes:
        """An entry's dictionary, in place or by reference."""
        ref = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", head)
        if ref:
            return self.heads.get(int(ref[1]), b"")
        at = re.search(rb"/" + name + rb"\s*<<", head)
        if not at:
            return b""
        depth, i = 1, at.end()
        while depth and i < len(head):
            pair = head[i : i + 2]
            depth += (pair == b"<<") - (pair == b">>")
            i += 2 if pair in (b"<<", b">>") else 1
        return head[at.end() : i]

    def pages(self) -> Iterator[tuple[int, bytes, tuple[float, ...]]]:
        """(number, resources, box) of the pages in order; both come down the page tree."""
        roots = [r for n, h in self.heads.items() if re.search(rb"/Type\s*/Catalog\b", h) for r in self.refs(h, b"Pages")]

        def walk(n: int, resources: bytes, box: tuple[float, ...], seen: frozenset[int]) -> Iterator[tuple[int, bytes, tuple[float, ...]]]:
            head = self.heads.get(n, b"")
            resources = self.inner(head, b"Resources") or resources
            stated = re.search(rb"/MediaBox\s*\[([^\]]*)\]", head)
            box = tuple(map(float, stated[1].split())) if stated else box
            if re.search(rb"/Type\s*/Page\b", head):
                yield n, resources, box
            for kid in self.refs(head, b"Kids"):
                if kid not in seen:
                    yield from walk(kid, resources, box, seen | {n})

        for root in roots:
            yield from walk(root, b"", PAGE, frozenset())

    def body(self, page: int) -> bytes:
        return b"\n".join(self.bodies.get(n, b"") for n in self.refs(self.heads[page], b"Contents"))

    def form(self, resources: bytes, name: bytes) -> int | None:
        """The form that a name stands for among resources."""
        m = re.search(re.escape(name) + rb"\s+(\d+)\s+\d+\s+R", self.inner(resources, b"XObject"))
        return int(m[1]) if m and re.search(rb"/Subtype\s*/Form\b", self.heads.get(int(m[1]), b"")) else None


def placed(file: File, body: bytes, resources: bytes, base: Matrix = SAME, within: tuple[int, ...] = ()) -> Iterator[tuple[str, float, float, float, int | None]]:
    """Texts that a stream shows: text, place of its baseline, size, and the form it is in, if any.

    Operands gather on a stack until an operator takes them.
    """
    stack: list = []
    kept: list[Matrix] = []
    page, text, line, size, lead = base, SAME, SAME, 0.0, 0.0

    def show(parts: list) -> Iterator[tuple[str, float, float, float, int | None]]:
        nonlocal text
        shown = "".join(p for p in parts if isinstance(p, str))
        at = times(text, page)
        if shown.strip():
            yield shown, at[4], at[5], size * abs(at[3]), within[-1] if within else None
        text = times((1, 0, 0, 1, LETTER * len(shown), 0), text)

    def move(x: float, y: float) -> None:
        nonlocal text, line
        text = line = times((1, 0, 0, 1, x, y), line)

    for m in _WORD.finditer(body):
        w = m[0]
        if w[:1] in b"(<":
            stack.append(literal(w))
        elif w[:1] == b"/" or w in (b"[", b"]"):
            stack.append(w)
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", w):
            stack.append(float(w))
        else:
            numbers = [s for s in stack if isinstance(s, float)]
            if w == b"cm" and len(numbers) >= 6:
                page = times(tuple(numbers[-6:]), page)
            elif w == b"q":
                kept.append(page)
            elif w == b"Q" and kept:
                page = kept.pop()
            elif w == b"BT":
                text = line = SAME
            elif w == b"Tf" and numbers:
                size = numbers[-1]
            elif w == b"TL" and numbers:
                lead = numbers[-1]
            elif w == b"Tm" and len(numbers) >= 6:
                text = line = tuple(numbers[-6:])
            elif w in (b"Td", b"TD") and len(numbers) >= 2:
                lead = -numbers[-1] if w == b"TD" else lead
                move(*numbers[-2:])
            elif w == b"T*":
                move(0, -lead)
            elif w in (b"Tj", b"TJ"):
                yield from show(stack)
            elif w in (b"'", b'"'):
                move(0, -lead)
                yield from show(stack)
            elif w == b"Do" and stack and isinstance(stack[-1], bytes):
                n = file.form(resources, stack[-1])
                if n is not None and n not in within:
                    head = file.heads[n]
                    own = re.search(rb"/Matrix\s*\[([^\]]*)\]", head)
                    matrix = times(tuple(map(float, own[1].split())), page) if own else page
                    yield from placed(file, file.bodies.get(n, b""), file.inner(head, b"Resources") or resources, matrix, (*within, n))
            stack = []


def engine(content: bytes) -> Iterator[tuple]:
    """(page, text, confidence, x0, y0, x1, y1) of each text that a file's pages show, from the top."""
    file = File(content)
    for number, (page, resources, box) in enumerate(file.pages(), 1):
        for text, x, y, size, _ in placed(file, file.body(page), resources):
            word, height = text.strip(), size or HEIGHT
            top = max(0.0, box[3] - y - height)
            yield number, word, 1.0, x - box[0], top, x - box[0] + LETTER * len(word), top + height


def page_text(files: DataFrame) -> DataFrame:
    """doc_id, page, source (CONTENTS of the page, FORM: of a form that it shows) and the texts shown, one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = File(content or b"")
                for number, (page, resources, _) in enumerate(file.pages(), 1):
                    shown: dict[str, list[str]] = {"CONTENTS": [], "FORM": []}
                    for text, *_, form in placed(file, file.body(page), resources):
                        shown["CONTENTS" if form is None else "FORM"].append(text)
                    rows += [(doc_id, number, source, "\n".join(lines)) for source, lines in shown.items() if lines]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page", "source", "raw_text"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, page long, source string, raw_text string")
