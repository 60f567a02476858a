import duckdb
import pytest

from passbook.llm import mixing


def brute_targets(words, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(words, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, share * sum(words.values())
    while True:
        rest = [s for s in order if s not in out]
        deal = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if deal[s] > most * words[s]]
        if not over:
            return out | deal
        for s in over:
            out[s] = most * words[s]
            left -= out[s]


def spark_targets(spark, words):
    frame = spark.createDataFrame(list(words.items()), "source string, words long")
    return {r["source"]: r["target"] for r in mixing.targets(frame).collect()}


def test_targets_cap_and_reshare(spark, rng):
    for words in ({"a": 100, "b": 1000, None: 1000}, {"a": 0}, {"a": 0, "b": 7}, {f"s{k}": rng.randrange(1 << rng.randrange(1, 20)) for k in range(300)} | {"é": 5, "Z": 9, None: 40}):
        assert spark_targets(spark, words) == pytest.approx(brute_targets(words))
    assert spark_targets(spark, {}) == {}


def test_sizes_and_targets_match_sql(spark, sf_dir):
    got = mixing.query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    sizes = con.sql(rf"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM '{sf_dir}/documents.parquet'").df()
    both = got.merge(sizes, on="doc_id")
    words = {s: int(g["size_y"].sum()) for s, g in both.groupby("source", dropna=False)}
    target = brute_targets(words)
    assert len(both) == len(got) and (both["size_x"] == both["size_y"]).all()
    assert both["source_size"].tolist() == [words[s] for s in both["source"]]
    assert both["target"].tolist() == pytest.approx([target[s] for s in both["source"]])


def test_flight_keeps_both_totals(rng):
    pi, size = [rng.random() for _ in range(500)], [float(rng.randrange(1, 4000)) for _ in range(500)]
    out = mixing.flight(pi, size)
    assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
    assert sum(out) == pytest.approx(sum(pi))
    assert sum(p * s for p, s in zip(out, size, strict=True)) == pytest.approx(sum(p * s for p, s in zip(pi, size, strict=True)))
    assert sum(0 < p < 1 for p in mixing.flight([0.5] * 7, [3.0] * 7)) <= 2


@pytest.mark.parametrize("block", [5, 2000])
def test_words_come_near_targets(spark, docs, block):
    mixed = mixing.mix(docs, block=block).toPandas()
    assert len(mixed) == docs.count() and mixed["copies"].between(0, 2).all()
    for _, g in mixed.groupby("source"):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= g["size"].max()
        assert abs(g["copies"].sum() - len(g) * g["target"].iloc[0] / g["source_size"].iloc[0]) <= 3
    again = mixing.mix(docs.repartition(3), block=block).toPandas()
    assert again.sort_values("doc_id")["copies"].tolist() == mixed.sort_values("doc_id")["copies"].tolist()


def test_edges(edge, empty):
    got = mixing.mix(edge).toPandas()
    assert len(got) == 11 and mixing.mix(empty).count() == 0
    assert got[got["doc_id"] == 1]["size"].iloc[0] == 0 and (got["copies"] <= 2).all()
    assert mixing.mixed_rows(edge).columns == edge.columns and mixing.mixed_rows(empty).count() == 0
    assert {tuple(r) for r in mixing.mixed_rows(edge).collect()} <= {tuple(r) for r in edge.collect()}
