"""Rows and headers of pages against plain versions over random pages."""

import pytest

from passbook.operators import documents, headers, layout

KINDS = "doc_id long, page long, tok long, text string, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def pages(spark):
    """Crowded pages of up to 60 tokens of uneven heights, in any reading order."""
    import random

    rng = random.Random(8)
    rows = []
    for doc in range(12):
        for page in (1, 2):
            toks = list(range(rng.choice((1, 7, 30, 60))))
            rng.shuffle(toks)
            for tok in toks:
                y = rng.choice((rng.uniform(0, 120), 12.0 * rng.randrange(9) + rng.uniform(-3, 3)))
                rows.append((doc, page, tok, "w", rng.uniform(0, 500), y, 0.0, y + rng.choice((2.0, 8.0, 9.5, 22.0))))
    return rows


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


def got(frame, value):
    return {(r["doc_id"], r["page"], r["tok"]): r[value] for r in frame.collect()}


def numbered(page, groups, key):
    order = sorted(range(len(groups)), key=lambda k: (key(groups[k]), k))
    return {(*page, tok): order.index(k) + 1 for k, g in enumerate(groups) for tok in g["toks"]}


def test_row_clusters_against_brute_force(spark, pages):
    want = {}
    for page, toks in by_page(pages).items():
        groups = []
        for *_, tok, _, _, top, _, end in sorted(toks, key=lambda r: (r[5], r[4], r[2])):

            def distance(g, top=top, end=end):
                return abs((top + end) - (g["top"] + g["end"])) / 2

            def fits(g, top=top, end=end):
                both = max(0, min(end, g["end"]) - max(top, g["top"]))
                return both / min(max(6, end - top), max(6, g["end"] - g["top"])) >= 0.35 or distance(g) <= 3.5

            home = min((g for g in groups if fits(g)), key=distance, default=None)
            if home is None:
                groups.append({"top": top, "end": end, "toks": [tok]})
            else:
                home.update(top=min(top, home["top"]), end=max(end, home["end"]), toks=[*home["toks"], tok])
        want |= numbered(page, groups, lambda g: g["top"])
    assert got(layout.cluster_rows(spark.createDataFrame(pages, KINDS)), "row") == want


@pytest.mark.parametrize(("tolerance", "moving", "down"), [(5.0, True, False), (3.5, False, True), (8.0, False, False)])
def test_anchored_rows_against_brute_force(spark, pages, tolerance, moving, down):
    want = {}
    for page, toks in by_page(pages).items():
        groups = []
        for r in sorted(toks, key=lambda r: r[2]):
            home = next((g for g in groups if abs(g["at"] - r[5]) <= tolerance), None)
            if home is None:
                groups.append({"at": r[5], "toks": [r[2]]})
            else:
                home["toks"].append(r[2])
                home["at"] = min(home["at"], r[5]) if moving else home["at"]
        want |= numbered(page, groups, lambda g: -g["at"] if down else g["at"])
    assert got(layout.anchored_rows(spark.createDataFrame(pages, KINDS), tolerance, moving, down), "row") == want


def test_reading_order(spark):
    rows = [(1, 1, 0, "c", 50.0, 10.0, 60.0, 18.0), (1, 1, 1, "a", 5.0, 13.0, 9.0, 20.0), (1, 1, 2, "b", 20.0, 16.4, 30.0, 20.0), (1, 1, 3, "d", 1.0, 20.0, 3.0, 28.0)]
    assert got(layout.reading_order(spark.createDataFrame(rows, KINDS)), "place") == {(1, 1, 1): 1, (1, 1, 2): 2, (1, 1, 0): 3, (1, 1, 3): 4}


def line(doc, page, y, *words, first=0):
    """Words (text, x0, x1) of one line."""
    return [(doc, page, first + k, t, float(a), float(y), float(b), y + 9.0) for k, (t, a, b) in enumerate(words)]


FULL = [("Txn", 10, 30), ("Date", 32, 60), ("Particulars", 90, 150), ("Chq", 160, 180), ("No", 182, 195), ("Withdrawal", 220, 270), ("(Dr)", 272, 290), ("Deposit", 300, 340), ("(Cr)", 342, 360), ("Balance", 400, 450)]


def test_headers_of_several_words(spark):
    rows = line(1, 1, 100, *FULL) + line(1, 1, 130, ("05/08/2026", 10, 60), ("debit", 90, 120), first=20)
    h = headers.page_headers(spark.createDataFrame(rows, KINDS)).first()
    assert [c["name"] for c in h["columns"]] == ["DATE", "DESCRIPTION", "REFERENCE", "DEBIT", "CREDIT", "BALANCE"]
    # "Txn" has a heading only together with "Date"; "No", "(Dr)" and "(Cr)" go on theirs.
    assert [(c["x0"], c["x1"]) for c in h["columns"]] == [(0, 75), (75, 155), (155, 207.5), (207.5, 295), (295, 380), (380, 10_000)]
    assert (h["y0"], h["y1"], h["score"], h["confidence"]) == (100, 109, 95, 1.0)


def test_lines_that_are_no_headers(spark):
    rows = line(1, 1, 100, ("Balance", 0, 20), ("Debit", 30, 60), ("Credit", 70, 90)) + line(2, 1, 50, ("Date", 0, 20)) + line(3, 1, 50, ("Details", 0, 20), ("Debit", 30, 60))
    assert headers.page_headers(spark.createDataFrame(rows, KINDS)).count() == 0


def test_schemas_of_pages(spark):
    rows = line(1, 2, 100, *FULL) + line(1, 4, 90, ("Date", 5, 30), ("Particulars", 90, 150), ("Debit", 220, 250)) + line(1, 3, 60, ("rows", 1, 9)) + line(2, 1, 10, ("nothing", 1, 9))
    frame = spark.createDataFrame(rows, KINDS)
    texts = spark.createDataFrame([(1, 1, "cover"), (1, 2, "table"), (1, 3, "rows"), (1, 4, "table"), (1, 5, "TERMS and conditions"), (1, 6, "more"), (2, 1, "nothing")], "doc_id long, page long, raw_text string")
    s = {(r["doc_id"], r["page"]): r for r in headers.page_schemas(headers.page_headers(frame), texts).collect()}
    assert {k: r["kind"] for k, r in s.items()} == {(1, 1): "INHERITED", (1, 2): "OWN", (1, 3): "INHERITED", (1, 4): "RECONCILED", (1, 6): "INHERITED"}
    assert len({tuple(c["name"] for c in r["columns"]) for r in s.values()}) == 1
    assert (s[1, 4]["y0"], s[1, 4]["confidence"], s[1, 3]["y0"], s[1, 3]["confidence"], s[1, 6]["confidence"]) == (90, 0.9, 40, 0.9, 0.81)


def test_second_dialect_bands(spark):
    """Six columns by their centres, and rows of words binned by them."""
    heads = [("Date", 10, 50), ("Particulars", 100, 180), ("Chq/Ref", 200, 240), ("Withdrawal", 260, 320), ("Deposit", 340, 390), ("Balance", 420, 480)]
    rows = line(1, 1, 100, *heads) + line(1, 1, 120, ("credit", 100, 130), ("1000.00", 345, 380), ("1010.64", 425, 470), first=20) + line(2, 1, 5, *heads[:1], heads[3])
    h = headers.band_headers(spark.createDataFrame(rows, KINDS)).collect()
    assert [(r["doc_id"], r["bottom"], [c["name"] for c in r["columns"]]) for r in h] == [(1, 109, ["DATE", "DESCRIPTION", "REFERENCE", "DEBIT", "CREDIT", "BALANCE"])]
    assert [(c["x0"], c["x1"]) for c in h[0]["columns"]][2:4] == [(180, 255), (255, 327.5)]


def test_evidence_of_tokens(spark):
    """A ledger's header and rows count as evidence when only words with places are known, also where a line's words differ in height."""
    rows = line(1, 1, 100, *FULL)
    for k in range(5):
        rows += [(d, p, t, w, x, y + (3 if t % 2 else 0), x1, y1) for d, p, t, w, x, y, x1, y1 in line(1, 1, 130 + 20 * k, ("05/08/2026", 10, 60), ("shop", 90, 120), ("12.50", 220, 250), ("99.00", 400, 450), first=20 + 10 * k)]
    pages = layout.page_text(spark.createDataFrame(rows, KINDS))
    assert pages.first()["raw_text"].split("\n")[:2] == ["Txn Date Particulars Chq No Withdrawal (Dr) Deposit (Cr) Balance", "05/08/2026 shop 12.50 99.00"]
    found = {r["signal"]: r["weight"] for r in documents.evidence(pages).collect()}
    assert (found["TABLE_HEADER"], found["LEDGER_ROWS"]) == (35, 25)
