"""Fields by labels, names, and chains of sources."""

import random

import pytest
from pyspark.sql import functions as F

from passbook.functions import narration as N
from passbook.functions import phrases
from passbook.operators import labels
from passbook.operators.chain import staged


def test_many_phrases_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc. ") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    some = list({"".join(rng.choice("abc. ") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    words = list({w.strip(". ") for w in some} - {""})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(phrases.has_phrase(F.col("t"), some), phrases.has_word(F.col("t"), words, r". ")).collect()
    assert [r[0] for r in rows] == [any(p in t for p in some) for t in texts]
    assert [r[1] for r in rows] == [any(_stands(t, w) for w in words) for t in texts]


def _stands(text, word):
    return any(text.startswith(word, i) and (i == 0 or text[i - 1] in ". ") and (i + len(word) == len(text) or text[i + len(word)] in ". ") for i in range(len(text)))


def test_names(spark):
    names = {"Ravi Kumar": True, "ab": False, None: False, "Ravi 2": False, "Ravi, Delhi": False, "Ravi Delhia": True, "Mollybanks": False, "Gstaad": False, "Anne-Pin": False, "Pinto Rao": True, "a/c Tower": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select(N.customer(F.col("n"))).collect()
    assert [r[0] for r in got] == list(names.values())
    low = ["customer", "Savings Account x", "my bank statement", "- Ravi K. :", "R. K.", "of", "page total", "Ravi7"]
    got = spark.createDataFrame([(n,) for n in low], "n string").select(N.holder_candidate(F.col("n"))).collect()
    assert [r[0] for r in got] == [False, False, False, True, False, False, True, False]


def test_all_matches_count(spark):
    """The first match that is a name, over all patterns and texts."""
    texts = [("", "Customer name: Nominee, Account holder - r.k. rao,"), ("Account name asha rao, address", "Customer name: ravi rao,"), ("", "x\nName: asha, y"), ("", "Mr. Page, none")]
    got = spark.createDataFrame(texts, "a string, b string").select(N.holder(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["R.K. Rao", "Asha Rao", "Asha", None]


KINDS = "doc_id long, page long, tok long, text string, x0 double, y0 double, x1 double, y1 double, height double"


def test_first_label_with_a_value(spark):
    t = [
        (1, 1, 1, "IFSC Code", 10, 50), (1, 1, 2, ":", 100, 50), (1, 1, 3, "utib0004378", 140, 52), (1, 1, 4, "Account No", 10, 90), (1, 1, 5, "Statement", 120, 90), (1, 2, 1, "A/c No", 10, 40), (1, 2, 2, "9250-1004", 120, 41), (1, 2, 3, "9111", 180, 41),
        (1, 1, 6, "Customer Name", 10, 120), (1, 1, 7, "Tower", 130, 120), (1, 1, 8, "Account Holder", 10, 140), (1, 1, 9, "Kumar", 190, 141), (1, 1, 10, "Rajat", 130, 139), (1, 1, 11, "far", 700, 140), (1, 1, 12, "Opening Balance", 10, 160), (1, 1, 13, "0.00", 130, 160),
        (1, 2, 4, "B/F", 10, 60), (1, 2, 5, "Rs.", 60, 60), (1, 2, 6, "49.13", 90, 60), (1, 1, 14, "Closing Balance", 10, 900), (1, 1, 15, "13,737.40", 130, 900), (1, 1, 16, "Closing Balance", 10, 100), (1, 1, 17, "5.00", 130, 100), (2, 1, 1, "Closing balance", 10, 10), (2, 1, 2, "7.00", 200, 10),
    ]
    rows = [(d, p, k, w, float(x), float(y), x + 80.0, y + 10.0, 1000.0) for d, p, k, w, x, y in t]
    got = {r["doc_id"]: r for r in labels.label_fields(spark.createDataFrame(rows, KINDS)).collect()}
    one = got[1]
    assert (one["ifsc"], one["account_number"], one["holder"]) == ("UTIB0004378", "925010049111", "Rajat Kumar")
    assert (float(one["opening_balance"]), float(one["closing_balance"])) == (49.13, 13737.40)
    assert float(got[2]["closing_balance"]) == 7 and got[2]["holder"] is None


def test_near_right_against_all_pairs(spark):
    from passbook.operators import layout

    rng = random.Random(2)
    toks = [(1, p, k, "w", x := rng.uniform(0, 900), y := rng.uniform(0, 300), x + rng.uniform(5, 90), y + rng.uniform(2, 40)) for p in (1, 2) for k in range(120)]
    frame = spark.createDataFrame(toks, KINDS.removesuffix(", height double"))
    got = {(r["page"], r["label"], r["tok"]) for r in layout.near_right(frame, frame.where("tok % 3 = 0")).collect()}
    want = {(b[1], b[2], a[2]) for a in toks for b in toks if a[1] == b[1] and a[2] != b[2] and b[2] % 3 == 0 and b[6] - 2 <= a[4] <= b[6] + 350 and abs((a[5] + a[7]) / 2 - (b[5] + b[7]) / 2) <= max(8, b[7] - b[5]) * 0.85}
    assert got == want


def test_stages_see_what_is_left(spark):
    docs = spark.createDataFrame([(k, k % 4) for k in range(20)], "doc_id long, v long")
    seen = []

    def stage(n):
        def run(left):
            seen.append({r[0] for r in left.collect()})
            return left.where(F.col("v") <= n).select("doc_id", "v")

        return run

    out = staged(docs, [("A", stage(0)), ("B", stage(2)), ("C", stage(2))])
    assert {(r["doc_id"], r["level"]) for r in out.collect()} == {(k, "A" if k % 4 == 0 else "B") for k in range(20) if k % 4 < 3}
    assert [len(s) for s in seen] == [20, 15, 5]


@pytest.mark.parametrize("text,value", [("$5,000.00", 5000), ("USD 12.345", 12.35), ("x", 0), ("", 0), ("AED -3", -3), ("12 kg", 12)])
def test_loose_amounts(spark, text, value):
    assert float(spark.createDataFrame([(text,)], "t string").select(labels.loose_amount(F.col("t"))).first()[0]) == value
