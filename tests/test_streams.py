"""Positioned words of files composed as the statements' fixtures are: A4 pages, columns at 40, 130, 340, 420 and 500 points."""

import zlib

import pytest
from pyspark.sql import functions as F

from passbook.functions import fields
from passbook.operators import documents, headers, labels, layout
from passbook.sources import guards, streams, tokens

COLUMNS = {"Date": 40, "Particulars": 130, "Debit": 340, "Credit": 420, "Balance": 500}
ROWS = [("2026-08-05", "Salary Credit", "", "50000.00", "60000.00"), ("2026-08-10", "UPI/P2M/Swiggy \\(food\\)", "650.00", "", "59350.00")]


def shown(x, top, text, size=9):
    """One text by its baseline, from the top."""
    return f"BT /F1 {size} Tf 1 0 0 1 {x} {842 - top} Tm ({text}) Tj ET\n"


def pdf(*bodies, form=b"", pack=True):
    """A file of one page a body under a tree of two levels; the form is object 5000."""
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 9 /MediaBox [0 0 595 842] /Resources << /Font << /F1 99 0 R >> /XObject << /Fm1 5000 0 R >> >> >>"}
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(bodies)))
    objs[3] = b"<< /Type /Pages /Parent 2 0 R /Kids [" + kids + b"] >>"
    streams_ = {}
    for k, body in enumerate(bodies):
        objs[10 + 2 * k] = b"<< /Type /Page /Parent 3 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        streams_[11 + 2 * k] = (b"", body.encode("latin-1"))
    streams_[5000] = (b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 0] ", form)
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objs.items())
    for n, (extra, raw) in streams_.items():
        data = zlib.compress(raw) if pack else raw
        out += b"%d 0 obj\n<< %s%s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, extra, b"/Filter /FlateDecode " if pack else b"", len(data), data)
    return out


@pytest.fixture(scope="module")
def statement():
    head = "".join(shown(40, y, t) for y, t in ((50, "Axis Bank"), (95, "Customer Name: x")))
    one = head + "".join(shown(x, 185, n) for n, x in COLUMNS.items()) + "".join(shown(x, 210 + 22 * k, v) for k, row in enumerate(ROWS) for x, v in zip(COLUMNS.values(), row, strict=True) if v)
    two = shown(40, 50, "Page 2", 11) + "q 1 0 0 1 100 200 cm /Fm1 Do Q\nBT 12 TL 40 700 Td (a) Tj T* [(b) -20 <6364>] TJ (e) ' ET"
    return one, two


@pytest.mark.parametrize("pack", [True, False])
def test_words_stand_where_the_page_puts_them(spark, statement, pack):
    content = pdf(*statement, form=b"BT /F1 8 Tf 10 20 Td (in the form \\101) Tj ET", pack=pack)
    got = tokens.extract(spark.createDataFrame([("d", content), ("broken", b"%PDF no objects"), ("null", None)], "doc_id string, content binary"), streams.engine).collect()
    at = {(r["page"], r["text"]): r for r in got}
    assert {r["doc_id"] for r in got} == {"d"}
    for name, x in COLUMNS.items():
        r = at[1, name]
        assert (r["x0"], r["y0"], r["y1"], r["x1"]) == (x, 185 - 9, 185, x + 5.5 * len(name))
    assert at[1, "UPI/P2M/Swiggy (food)"]["x0"] == 130 and at[1, "59350.00"]["y1"] == 232
    form = at[2, "in the form A"]
    assert (form["x0"], form["y1"]) == (100 + 5 + 10, 842 - 220)
    assert [(at[2, t]["x0"], at[2, t]["y1"]) for t in ("a", "bcd", "e")] == [(40, 142), (40, 154), (40, 166)]


def test_pages_and_forms_apart(spark, statement):
    content = pdf(*statement, form=b"BT (form) Tj ET")
    got = {(r["page"], r["source"]): r["raw_text"] for r in streams.page_text(spark.createDataFrame([("d", content)], "doc_id string, content binary")).collect()}
    assert set(got) == {(1, "CONTENTS"), (2, "CONTENTS"), (2, "FORM")} and got[2, "FORM"] == "form" and got[2, "CONTENTS"] == "Page 2\na\nbcd\ne"


def test_a_form_that_shows_itself_ends(spark):
    content = pdf("/Fm1 Do", form=b"BT (x) Tj ET /Fm1 Do")
    assert [t[1] for t in streams.engine(content)] == ["x"]


def test_from_bytes_to_transactions(spark, statement):
    """Words, headers, rows and columns of a file give its transactions."""
    files = spark.createDataFrame([(7, pdf(statement[0]))], "id long, content binary")
    toks = tokens.extract(files.select(F.col("id").alias("doc_id"), "content"), streams.engine).withColumn("doc_id", F.col("doc_id").cast("long"))
    heads = headers.page_headers(toks)
    assert [c["name"] for c in heads.first()["columns"]] == ["DATE", "DESCRIPTION", "DEBIT", "CREDIT", "BALANCE"]
    below = layout.table_zone(toks, heads.select("doc_id", "page", F.col("y1").alias("header_y1"))).where("y0 > header_y1")
    named = layout.assign_columns(below, heads.select("doc_id", "page", F.posexplode("columns").alias("ord", "c")).select("doc_id", "page", "ord", "c.name", "c.x0", "c.x1"))
    cells = named.join(layout.cluster_rows(below), ["doc_id", "page", "tok"]).groupBy("doc_id", "row").pivot("column", ["DATE", "DESCRIPTION", "DEBIT", "CREDIT", "BALANCE"]).agg(F.first("text"))
    blank = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    rows = cells.select("doc_id", F.col("row").alias("seq"), F.to_date("DATE").alias("d"), blank("DESCRIPTION", "description"), blank("DEBIT", "debit_raw"), blank("CREDIT", "credit_raw"), blank("BALANCE", "balance_raw"))
    t = layout.finalize(layout.reconstruct(rows)).orderBy("segment").collect()
    assert [(r["type"], float(r["amount"]), float(r["balance"])) for r in t] == [("CREDIT", 50000, 60000), ("DEBIT", 650, 59350)]
    assert labels.label_fields(toks.withColumn("height", F.lit(842.0))).count() == 0


def test_files_that_cannot_be_read(spark, statement):
    good = pdf(*statement)
    rows = [("good", good), ("locked", good + b"trailer << /Encrypt 5 0 R >>"), ("none", b"%PDF-1.4 nothing"), ("null", None), ("long", pdf(*["BT (x) Tj ET"] * 101))]
    got = {r["doc_id"]: (r["pages"], r["error_code"]) for r in guards.readable(spark.createDataFrame(rows, "doc_id string, content binary")).collect()}
    assert got == {"good": (2, None), "locked": (0, "ENCRYPTED_PDF"), "none": (0, "CORRUPTED_PDF"), "null": (0, "CORRUPTED_PDF"), "long": (101, "PAGE_LIMIT_EXCEEDED")}


def test_weak_scans_are_done_again(spark):
    """A page without tokens and one with few unsure ones are scanned again; the scan with more tokens counts."""
    first = [(1, 1, 0.9, "a"), *[(1, 2, 0.2, "b")] * 3, *[(1, 3, 0.2, "c")] * 2, *[(1, 4, 0.1, "d")] * 10]
    second = {0: 4, 2: 3, 3: 5}
    asked = []

    def again(pages):
        asked.extend(sorted(r["page"] for r in pages.collect()))
        return spark.createDataFrame([(1, p, 0.5, "new") for p, n in second.items() for _ in range(n)], "doc_id long, page long, conf double, text string")

    pages = spark.createDataFrame([(1, p, "scan") for p in range(5)], "doc_id long, page long, image string")
    out = tokens.rescanned(pages, spark.createDataFrame(first, "doc_id long, page long, conf double, text string"), again).groupBy("page", "text").count().collect()
    assert asked == [0, 2, 3] and {(r[0], r[1]): r[2] for r in out} == {(0, "new"): 4, (1, "a"): 1, (2, "b"): 3, (3, "new"): 5, (4, "d"): 10}


def test_heads_feet_and_warnings(spark):
    text = "\n".join(f"line {k}" for k in range(1, 51))
    r = spark.createDataFrame([(text,), ("one",)], "t string").select(fields.head_lines(F.col("t")).alias("h"), fields.foot_lines(F.col("t")).alias("f")).collect()
    assert (r[0]["h"].split("\n")[-1], r[0]["f"].split("\n")[0], r[0]["f"].count("\n")) == ("line 35", "line 21", 29) and r[1]["h"] == r[1]["f"] == "one"
    w = documents.warnings(spark.createDataFrame([(1, 0, 0.0), (2, 5, 3.0), (3, 5, 0.01)], "acct long, n long, difference double")).orderBy("acct").collect()
    assert [r["n_warnings"] for r in w] == [1, 1, 0] and w[1]["warnings"] == ["Balance difference of 3.00"]
