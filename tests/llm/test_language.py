import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm.language import SpectrumClassifier, _codes, grams_of, identify


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    found = identify(docs, ~held).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(found) > 150 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)


def test_edge_cases(spark):
    rows = [(i, f"the quick brown fox {i} and the dog", "en", 1) for i in range(20)] + [(100 + i, f"der schnelle braune fuchs {i} und der hund", "de", 1) for i in range(20)]
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, "12 34 !!", "de", 1), (203, "und der hund " * 30_000, None, 1), (None, "the dog and the fox", "xx", 1), (None, "the fox", None, 1), (204, "日本語", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = {r.doc_id: r for r in identify(docs, F.col("doc_id").isNotNull()).collect()}
    assert [found[i].lang_pred for i in (0, 100, 203)] == ["en", "de", "de"] and found[204].lang_pred in ("en", "de")
    assert [(found[i].lang_pred, found[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert identify(docs, F.col("doc_id").isNotNull()).count() == len(rows)
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0


def test_kernel_counts_shared_grams():
    a, b = grams_of(_codes("Abc")), grams_of(_codes("abd"))
    assert len(a) == len(b) == 6 and len(np.intersect1d(a, b)) == 3  # a, b and ab
    assert _codes("a1 -b").tolist() == [97, 32, 98]
    assert SpectrumClassifier.fit(["1"], ["x"]) is None
    model = SpectrumClassifier(["x"], [a, b], np.zeros((3, 1)))
    assert np.allclose(model.kernel([a, b, grams_of(_codes("xyz"))]), [[1, 0.5], [0.5, 1], [0, 0]])


def test_every_language_has_landmarks():
    texts = [chr(0x4E00 + 50 * i) * 3 + chr(0x4E10 + 50 * i + j) for i in range(150) for j in range(5)]
    model = SpectrumClassifier.fit(texts, [f"l{i:03}" for i in range(150) for _ in range(5)])
    assert len(model.landmarks) == 600 and len(model.languages) == 150
    assert model.predict(texts)[0] == [f"l{i:03}" for i in range(150) for _ in range(5)]


def test_query_against_plain_kernels(spark, sf):
    """The registered query against kernels counted with sets of n-grams, text by text."""
    from sparkloom.llm.language import learning_sample
    from sparkloom.llm.queries import op4_language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2) & F.col("doc_id").isNotNull()
    sample = learning_sample(docs, learn)
    model = SpectrumClassifier.fit(*sample)

    def spectrum(text):
        out = "".join(c if c.isalpha() else " " for c in text.lower())
        out = re.sub(" +", " ", out)
        return {out[i : i + n] for n in (1, 2, 3) for i in range(len(out) - n + 1)}

    turn, order = {}, []
    for i, lang in enumerate(sample[1]):
        turn[lang] = turn.get(lang, 0) + 1
        order.append((turn[lang], i))
    marks = [spectrum(sample[0][i]) for _, i in sorted(order)[: len(model.landmarks)]]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op4_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        own = spectrum(texts[r.doc_id])
        k = [len(own & z) / (len(own) * len(z)) ** 0.5 for z in marks]
        value = np.array(k) @ model.weights[:-1] + model.weights[-1]
        assert abs(r.score - min(1, max(0, (value.max() + 1) / 2))) < 1e-3
        assert r.lang_pred == model.languages[int(value.argmax())] or np.sort(value)[-1] - np.sort(value)[-2] < 1e-3
