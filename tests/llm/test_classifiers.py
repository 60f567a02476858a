import numpy as np
import pytest

from passbook.llm import langid, quality, toxicity


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def held_out(spark, larger, query, column, table="labels"):
    got = query(spark, larger).toPandas()
    truth = spark.read.parquet(f"{larger}/{table}.parquet").select("doc_id", column).toPandas()
    both = got.merge(truth, on="doc_id")
    assert got["score"].between(0, 1).all() and len(got) == 1000
    return both[both["held_out"]]


def test_language_of_held_out_documents(spark, larger):
    out = held_out(spark, larger, langid.query, "lang", "documents")
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() > 0.98


def test_quality_of_held_out_documents(spark, larger):
    out = held_out(spark, larger, quality.query, "quality")
    assert ((out["score"] >= 0.5) == out["quality"]).mean() > 0.93
    assert (out["predicted"] == (out["score"] >= 0.7)).all()


def test_toxicity_of_held_out_documents(spark, larger):
    out = held_out(spark, larger, toxicity.query, "toxic")
    assert (out["predicted"] == out["toxic"]).mean() > 0.93
    assert out.loc[out["toxic"] == 0, "predicted"].mean() < 0.03


def test_language_edges(spark, edge, empty):
    model = langid.train(edge)
    got = {r["doc_id"]: r for r in langid.identify(edge, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[7]["lang_pred"] == "fr"
    assert langid.train(empty) is None
    assert {r["lang_pred"] for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_family_first():
    model = langid.Model(["germanic", "romance"], {"germanic": ["de", "en"], "romance": ["es", "fr"]}, [("de", "en"), ("es", "fr")], np.zeros((0, 4)), np.zeros(4))
    langs, scores = model.predict(np.array([[3.0, -3, -1, 9], [-1, 1, 9, -2]]))
    assert langs == ["en", "fr"] and (scores > 0.5).all()


def test_trees_learn_an_interaction(rng):
    x = np.array([[rng.random(), rng.random(), rng.random()] for _ in range(3000)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_and_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(8, 1, 1), (8, 0, 0), (2, 0, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    forest = quality.train(edge, labels)
    assert quality.score(edge, forest).count() == 11 and quality.score(empty, forest).count() == 0
    assert quality.train(empty, labels).score(np.zeros((1, len(quality.NAMES)))).tolist() == [0.5]
    lexicon, w = toxicity.train(edge, labels.where("false"))
    rude = spark.createDataFrame([(1, "you idiot, you stupid pathetic moron"), (2, "a calm and kind remark")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rude, lexicon, w).collect()}
    assert got[1] > 0.7 > got[2]
    assert toxicity.score(edge, lexicon, w).count() == 11 and toxicity.score(empty, lexicon, w).count() == 0


def test_label_model_finds_the_better_voter(rng):
    truth = np.array([rng.random() < 0.3 for _ in range(2000)])
    vote = lambda p: np.array([1 if t == (rng.random() < p) else -1 for t in truth])
    v = np.stack([vote(0.95), vote(0.9), vote(0.9), vote(0.55)], axis=1)
    post = toxicity.label_model(v, 0.3)
    assert ((post > 0.5) == truth).mean() > 0.93


def test_toxicity_features_match_a_search_of_everything(rng):
    lexicon = {"grim": 0, "vile": 2, "rott*4": 1, "wretch*6": 2, "wret*4": 0}
    words = "you they ur idiot MORON dumb kill hurt punish him yourself shut up get lost drop dead hate nobody likes people are lot should grim vile rotten wretched wretch calm".split()
    texts = ["", "".join(["x"] * 500), "you\u00a0idiot", "idiot9 _moron"] + ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", ". ", "\n", "-"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    voters, fired = toxicity.Voters(lexicon), np.zeros(toxicity.N_FEATURES)
    for text in texts:
        low, slow = text.lower(), [0.0] * toxicity.N_FEATURES
        for word in toxicity._WORD.findall(low):
            slow[-1] += 1
            slow[0] += word in toxicity.INSULTS
            slow[1] += word == "grim"
            slow[3] += word == "vile"
            slow[5] += word.startswith("rott") and len(word) > 4
            slow[4] += word.startswith("wret") and len(word) > 4
        slow[7:11] = [len(pattern.findall(low)) for pattern in toxicity.PATTERNS.values()]
        assert voters.features(text) == slow, text
        fired += slow
    assert (fired[[0, 1, 3, 4, 5, 7, 8, 9, 10]] > 0).all()


def test_every_language_is_learned(spark):
    """More languages than families, two of them with one document; the bounds on rows and features leave one of each."""
    names = [f"x{k}" for k in range(104)] + ["de", "nl"]
    rows = [(100 * k + j, " ".join(chr(0x4E00 + 37 * k + (7 * i * j) % 30) * 3 for i in range(20)), lang) for k, lang in enumerate(names) for j in range(1 if k in (3, 104) else 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in ({}, {"most_rows": 50}, {"most_features": 10}):
        model = langid.train(frame, **most)
        assert sorted(x for f in model.families for x in model.members[f]) == sorted(names)
    got = langid.identify(frame, langid.train(frame), ("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_margins_against_slow_sums(spark, docs):
    """Language and score from n-grams of each text counted one by one, and the votes of all machines."""
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        raw = bytes(b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in (r["text"] or "").encode())
        raw = b"   " + raw + b"    "
        sums, n = np.zeros(len(model.bias)), 0
        for k in langid.ORDERS:
            for i in range(len(raw) - 4):
                gram = int.from_bytes(raw[i : i + k], "little")
                sums += model.weights[((gram + k) * 0x9E3779B1) % 2**32 >> (32 - langid.BITS)]
                n += 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        langs, scores = model.predict((sums * langid.SCALE / n + model.bias)[None])
        assert got[r["doc_id"]]["lang_pred"] == langs[0] and abs(got[r["doc_id"]]["score"] - scores[0]) < 1e-3


def test_trees_against_slow_walks_and_splits(rng):
    """Scores by walking each tree node by node; the first split by trying every cut of every column."""
    x = np.array([[rng.random(), rng.randrange(5), rng.gauss(0, 1)] for _ in range(600)])
    y = ((x[:, 0] > 0.6) | (x[:, 1] == 3)).astype(float)
    forest = quality.fit(x, y)
    for row, score in zip(x[:80], forest.score(x[:80]), strict=True):
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12
    p = y.mean()
    g, h = y - p, p * (1 - p)

    def gain(j, cut):
        left = x[:, j] <= cut
        n = left.sum()
        if n < 20 or len(y) - n < 20:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h * m.sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h * len(y) + 1)

    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    best = max(gain(j, c) for j in range(3) for c in cuts[j])
    assert abs(gain(forest.feature[0][0], forest.threshold[0][0]) - best) < 1e-9
