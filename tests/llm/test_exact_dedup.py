import hashlib

from pyspark.sql import functions as F

from sparkloom.llm.exact_dedup import drop_copies, exact_groups

SCHEMA = "doc_id long, text string, digest string, salt int, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, False) for i, t in rows], SCHEMA)


def test_groups_winners_and_edge_cases(spark):
    long = "word " * 40_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, "A"), (None, "a"), (None, "z"), (8, "a "), (2, "a")]
    got = {(r.doc_id, bytes(r.digest)): r for r in exact_groups(docs(spark, rows)).collect()}
    key = lambda i, t: got[(i, hashlib.sha256(t.encode()).digest())]
    assert exact_groups(docs(spark, rows)).count() == len(rows)
    assert (key(1, "a").keep_id, key(1, "a").group_size, key(1, "a").kept, key(2, "a").kept) == (2, 4, False, True)
    assert (key(3, "").keep_id, key(4, "").kept) == (4, True)
    assert (key(5, long).keep_id, key(6, long).kept) == (6, True)
    assert not key(None, "a").kept and key(None, "z").kept and key(None, "z").keep_id is None
    assert key(7, "A").group_size == key(8, "a ").group_size == 1


def test_hot_group_and_other_columns(spark):
    df = docs(spark, [(i, "copy" if i % 3 == 0 else f"t{i}") for i in range(600)])
    left = drop_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i in range(600) if i % 3] + [597])


def test_repeated_rows_leave_one(spark):
    assert sorted((r.doc_id, r.text) for r in drop_copies(docs(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "b")])).collect()) == [(1, "a"), (2, "b")]


def test_empty_table(spark):
    assert exact_groups(docs(spark, [])).count() == 0 and drop_copies(docs(spark, [])).count() == 0


def test_equal_digests_do_not_make_texts_equal(spark):
    weak = lambda c: F.substring(c, 1, 1).cast("binary")
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ac", "ab", "ab", None, ""])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(docs(spark, rows), digest=weak).collect()}
    assert got == {0: (2, 2, False), 2: (2, 2, True), 1: (6, 3, False), 5: (6, 3, False), 6: (6, 3, True), 3: (3, 1, True), 4: (4, 1, True), 7: (8, 2, False), 8: (8, 2, True)}


def test_extra_columns_may_have_any_name(spark):
    names = ("digest", "_digest", "gone", "gone_digest", "__gone", "__digest", "kept", "salt")
    docs = spark.createDataFrame([(i, f"t{i % 3}", *[i] * len(names)) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    left = drop_copies(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(i, f"t{i % 3}", *[i] * len(names)) for i in (6, 7, 8)]
