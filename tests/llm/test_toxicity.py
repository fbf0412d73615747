import random
import re

import numpy as np

from sparkloom.llm.toxicity import CHAIN, ToxicityChain, clean_documents, clusters, score_toxicity


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bad = ["idiot", "worthless", "scum", "vexu"]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w = r.choice(bad)
                text.insert(r.randrange(len(text)), w + r.choice(words)[:2] if w == "vexu" else w)
        rows.append((i, " ".join(text).capitalize(), int(toxic)))
    return rows


def test_held_out_accuracy_and_chain():
    rows = corpus(900, 1)
    chain = ToxicityChain.fit([t for _, t, _ in rows[:600]], [y for *_, y in rows[:600]])
    p = chain.predict([t for _, t, _ in rows[600:]])
    y = np.array([y for *_, y in rows[600:]])
    assert p.shape == (300, len(CHAIN)) and ((p[:, -1] >= chain.threshold) == y).mean() > 0.98
    # a later model has a weight for each earlier category
    d = len(chain.vocabulary)
    assert [len(w) for _, w in chain.links] == [d + k + 1 for k in range(len(CHAIN))]
    assert (p[y == 1, :-1] > 0.5).any(1).mean() > 0.8 and (p[y == 0, :-1] > 0.5).any(1).mean() < 0.1  # toxic rows are of some category


def test_categories_are_clusters_of_toxic_rows():
    r = np.random.default_rng(0)
    groups = np.repeat([0, 1, 2], [50, 30, 20])
    x = np.eye(3)[groups].repeat(5, axis=1) + 0.1 * r.random((100, 15))
    order = r.permutation(100)
    assert (clusters(x[order], 3) == groups[order]).all()
    assert clusters(x[:1], 4).tolist() == [0] and set(clusters(np.ones((9, 4)), 4)) == {0} and set(clusters(np.zeros((3, 2)), 4)) == {0}


def plain_chain(chain, text):
    """Probabilities of one text, word by word and link by link."""
    import math

    counts = {}
    for w in {m.lower() for m in re.findall(r"[^\W\d_]+", text or "")}:
        for f in [w] + [w[:n] + "*" for n in (4, 5, 6) if len(w) > n]:
            if f in chain.vocabulary:
                counts[f] = counts.get(f, 0) + 1
    out = []
    for _, w in chain.links:
        z = w[-1] + sum(math.log2(1 + n) * w[chain.vocabulary[f]] for f, n in counts.items()) + sum(p * w[len(chain.vocabulary) + k] for k, p in enumerate(out))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_query_against_the_plain_chain(spark, sf):
    from sparkloom.llm.queries import op6_toxicity
    from sparkloom.llm.toxicity import labelled_sample

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = ToxicityChain.fit(*labelled_sample(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op6_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        p = plain_chain(chain, texts[r.doc_id])
        assert np.allclose([r[f"p_{c}"] for c in CHAIN], p, atol=1e-6) and (abs(p[-1] - chain.threshold) < 1e-6 or r.toxic == (p[-1] >= chain.threshold))


def test_out_of_fold_probabilities_come_from_models_that_have_not_seen_the_row(monkeypatch):
    """Each link but for its last fit is fitted without a fold, and later links see what those models say of that fold."""
    from sparkloom.llm import toxicity

    calls, fit = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, **o: calls.append((x.copy(), y.copy())) or fit(x, y, **o))
    rows = corpus(300, 4)
    ToxicityChain.fit([t for _, t, _ in rows], [y for *_, y in rows], folds=4)
    last = [x for x, y in calls if len(y) == 300]
    assert 3 <= len(last) <= len(CHAIN) and last[1].shape[1] == last[0].shape[1] + 1  # a category of fewer rows than folds has no model
    first = [(x, y) for x, y in calls[:4]]
    column = last[1][:, -1]  # what the second link sees of the first
    for k, (x, y) in enumerate(first):
        out = np.arange(300) % 4 == k
        assert len(x) == 300 - out.sum()
        assert np.allclose(column[out], toxicity._prob(last[0][out], fit(x, y)))


def test_whole_long_texts_are_read():
    rows = corpus(600, 2)
    chain = ToxicityChain.fit([t for _, t, _ in rows], [y for *_, y in rows])
    clean = " ".join(t for _, t, y in rows[:200] if not y)
    p = chain.predict([clean + " idiot worthless scum idiot", None, ""])
    assert p[0, -1] > chain.threshold and (p[1:, -1] < chain.threshold).all()


def test_documents_and_edge_cases(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (2, None), (1, 0), (1, 0)], "doc_id long, toxic int")
    scored = score_toxicity(docs, labels)
    assert scored.count() == 404
    verdict = {r.doc_id: r.toxic for r in scored.collect()}
    assert np.mean([verdict[i] == bool(y) for i, _, y in rows[300:]]) > 0.95 and not verdict[5000] and not verdict[5001]
    left = clean_documents(docs, labels)
    assert left.columns == docs.columns and left.count() == scored.where("not toxic").count()
    none = labels.limit(0)
    assert score_toxicity(docs, none).where("toxic or p_toxic > 0").count() == 0 and clean_documents(docs, none).count() == 404
    assert clean_documents(docs, labels.where("toxic = 0")).count() == 404
    assert score_toxicity(docs.limit(0), labels).count() == 0 and clean_documents(docs.limit(0), labels).count() == 0


def test_sf_labels(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = "doc_id % 4 = 1"
    found = score_toxicity(docs, labels.where(f"not ({held})")).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(held).collect()
    wrong = sum(r.toxic != bool(r.y) for r in found)
    lost = sum(r.toxic and not r.y for r in found)
    assert wrong / len(found) < 0.02 and lost / len(found) < 0.005
