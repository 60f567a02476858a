import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from passbook.llm import linededup, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_match_sql(spark, sf):
    got = linededup.query(spark, f"/root/testdata/{sf}").toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(linededup.SQL).df().sort_values("doc_id", ignore_index=True)
    for c in got.columns:
        assert (got[c] == want[c]).all()
    assert got["n_removed"].sum() > 0


def test_boilerplate_goes_whatever_its_share(spark):
    passage = "a license passage that is much longer than what the page itself has to say, " * 3
    rows = [(s, f"own {s}\n{passage}", f"s{s}") for s in range(12)] + [(100 + s, passage, f"s{s}") for s in range(12)]
    out = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {s: f"own {s}" for s in range(12)} | {100 + s: passage for s in range(12)}


def test_lines_near_the_threshold(spark):
    rows = [(1000 * n + s, f"own text of document {n} {s} and more of it\nline of {n} sites", f"s{s}") for n in range(2, 20) for s in range(n)]
    out = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8, counts=("n", "gone")).collect()
    assert {r["doc_id"] // 1000 for r in out if r["gone"]} == set(range(8, 20))


def test_line_edges(edge, empty):
    got = linededup.remove(edge, min_sites=2)
    assert got.count() == 11 and linededup.remove(empty).count() == 0
    assert got.columns == edge.columns
    with pytest.raises(ValueError):
        linededup.remove(edge, counts=("n", "SCORE"))
    assert got.where("doc_id = 8").first()["text"]  # a copied document stays whole
    assert got.where("doc_id = 1").first()["text"] is None


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[words[k], words[k + 1], words[k + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark, docs, texts, sf_dir):
    for r in rules.query(spark, sf_dir).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_thresholds_follow_the_group(spark):
    text = lambda k, symbols: " ".join(f"word{k}x{i}" for i in range(80)) + " #" * symbols
    rows = [(k, text(k, 20), "en", "code") for k in range(40)] + [(100 + k, text(k, 0), "en", "news") for k in range(40)] + [(200, text(200, 20), "en", "news"), (201, text(201, 20), None, None)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(rules.counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert [i for i in kept if not kept[i]] == [200]


def test_rule_edges(edge, empty):
    got = defaultdict(list)
    for r in rules.judge(rules.counts(edge)).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == 11 and rules.judge(rules.counts(empty)).count() == 0
    assert got[6][0]["n_repeat_words"] == 60_000 and got[1][0]["base_failed"] and got[7][0]["word_chars"] == 5000


def test_verdicts_against_sorted_quartiles(docs, edge):
    """Kept or not, from quartiles of each group's sorted ratios (groups here are smaller than the sketches' accuracy)."""
    for frame in (docs, edge.select("doc_id", "text", "lang", "source").unionByName(docs.select("doc_id", "text", "lang", "source"))):
        counted = [r.asDict() for r in rules.judge(rules.counts(frame)).collect()]
        rated = []
        for r in counted:
            n = max(1, r["n_words"])
            rated.append({"word_length": r["word_chars"] / n, "symbols": r["n_symbols"] / n, "dup_lines": r["n_dup_lines"] / max(1, r["n_lines"]), "repeats": r["n_repeat_words"] / n})
        groups = {}
        for r, x in zip(counted, rated, strict=True):
            assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
            if not r["base_failed"]:
                groups.setdefault((r["lang"], r["source"]), []).append(x)
        failed = 0
        for r, x in zip(counted, rated, strict=True):
            kept = not r["base_failed"]
            for k, slack in rules.SLACK.items():
                values = sorted(g[k] for g in groups.get((r["lang"], r["source"]), []))
                if values:
                    low, high = (values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.75))
                    room = rules.REACH * (high - low) + slack
                    kept = kept and x[k] <= high + room and (k != "word_length" or x[k] >= low - room)
            assert r["kept"] == kept
            failed += not kept
        assert 0 < failed < len(counted)
