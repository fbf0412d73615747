"""The pipeline's stages against brute force, and the registered queries of all operators."""

import collections
import itertools
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import mixing
from sparkloom.llm.packing import WordIds, _first_bound, _second_bound
from sparkloom.llm.queries import ORACLE, QUERIES, tokenizer
from sparkloom.llm.toxicity import ToxicityChain, labelled_sample
from test_mixing import plain_mix
from test_ngram_join import brute
from test_toxicity import plain_chain


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]

    before, after = kept["toxicity"]
    chain = ToxicityChain.fit(*labelled_sample(before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if plain_chain(chain, r.text)[-1] < chain.threshold)

    before, after = kept["exact_dedup"]
    last = {}
    for r in before.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())

    before, after = kept["ngram_jaccard_join"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == sorted({g for _, _, g in brute(rows)})

    before, after = kept["mixing"]
    want = plain_mix([(r.doc_id, r.text, r.source) for r in before.collect()], mixing.BLOCK_WORDS, mixing.SHARD_WORDS, documents_stay_whole=True)
    order = sorted((*place, i) for i, _, _, places in want for place in places)
    after.write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    assert [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()] == [i for *_, i in order]
    rows = {r.doc_id: r for r in before.collect()}
    assert all(r == rows[r.doc_id] for r in after.collect())

    before, after = kept["best_fit_packing"]
    words = WordIds(tokenizer()).tokenizer
    want = collections.Counter()
    for r in before.collect():
        ids = np.array([*words.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    got = after.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 and [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts)[:-1])] for parts in sequences.values())
    hist = collections.Counter(r.length for r in got)
    assert len(sequences) == max(_first_bound(hist, 2048), _second_bound(hist, 2048))  # no packing takes fewer


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_what_tables_may_hold(spark, sf, tmp_path):
    """Nulls in all columns, empty and very long texts, repeated rows, no rows at all, and a column of a stage's own name."""
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    long = " ".join(f"w{i}" for i in range(20_000))
    odd = [(None, None, None, None, None), (None, "a b c", None, None, 1), (900, "", "en", None, 0), (901, long, "en", "s", 1), (902, long, "en", "s", 1), (901, long, "en", "s", 1), (903, "same", "en", "s", 1), (903, "same", "en", "s", 1)]
    docs = real.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(spark.createDataFrame(odd, STAGE_SCHEMA)).withColumn("gone", F.lit(1)).withColumn("position", F.lit("p"))
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            columns, before = out.columns, out.count()
            stage(spark, out, sf).write.parquet(path := str(tmp_path / f"{name}-{before}"))
            out = spark.read.parquet(path)
            if name != "best_fit_packing":
                assert out.columns == columns
            if name == "exact_dedup" and before:
                assert out.where("doc_id = 903").count() == 1 and out.where("doc_id in (901, 902)").select("doc_id").collect()[0][0] == 902
        assert (out.count() > 0) == (start is docs)


def test_run_gives_the_stages_rows(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    names = sorted(out.columns)
    assert sorted(map(tuple, out.select(names).collect())) == sorted(map(tuple, docs.select(names).collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_whole_tables(spark, sf, name):
    rows = QUERIES[name](spark, sf).count()
    table = {"op1_chat_format": "conversations", "op5_embedding_dedup": "embeddings", "op7_warc": "pages"}.get(name, "documents")
    assert rows >= spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = c.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entry():
    found = __spark_entry__.queries()
    assert {"pipeline", *QUERIES} <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
