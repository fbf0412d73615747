import random

import numpy as np
import pytest

from sparkloom.llm.ngram_join import COORDINATES, TARGET_RECALL, minima, miss, one_of_each_group, plan_runs, shingles, similarity_join

SCHEMA = "doc_id long, text string, key string, n int, kept int"


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return [(rows[i][0], links[i], rows[find(i)][0]) for i in range(len(rows))]


def corpus(seed, n, clusters, passage=True):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    shared = [word() for _ in range(40)]
    rows = []
    for size, edits in clusters:
        base = [word() for _ in range(90)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    for _ in range(n):
        w = [word() for _ in range(r.randint(1, 120))]
        rows.append(" ".join(w + shared if passage and r.random() < 0.5 else w))
    rows += rows[:15]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA)
    return similarity_join(df, **options)


@pytest.mark.parametrize("options", [{}, {"small": 6, "deepest": 3}, {"small": 4, "deepest": 1}, {"small": 4, "block": 7}, {"small": 4, "deepest": 4, "block": 15}])
def test_against_brute_force(spark, options):
    rows = corpus(7, 150, [(40, 4), (12, 3), (5, 2), (2, 1)])
    got = sorted((r.doc_id, r.n_links, r.group_id) for r in run(spark, rows, **options).collect())
    want = brute(rows)
    assert got == want and sum(x[1] for x in want) > 400


def test_lower_threshold_and_other_shingles(spark):
    rows = corpus(9, 60, [(20, 8)], passage=False)
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_links, r.group_id) for r in similarity_join(df, threshold=0.6).collect())
    assert got == brute(rows, 0.6)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "one"), (6, "one two three four"), (7, "one two three four five"), (None, "one"), (None, "solo"), (8, long), (9, long + " end"), (9, long + " end"), (10, "One")]
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].n_links, by[i].class_id, by[i].kept) for i in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert (by[4].n_links, by[4].class_size, by[5].group_id, by[5].kept) == (2, 3, 4, False)
    assert by[6].n_links == by[7].n_links == by[10].n_links == 0
    assert (by[8].n_links, by[9].n_links, by[9].group_id) == (2, 2, 8)
    assert run(spark, []).count() == 0
    assert run(spark, [(1, None)]).count() == 1


def test_rows_without_ids_are_compared(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(w)), (None, " ".join(w[:-1] + ["x"])), (None, " ".join(w)), (5, " ".join(w[:-1] + ["y"])), (None, "other words here"), (None, None)]
    got = sorted((r.n_links, r.group_id is None) for r in run(spark, rows).collect())
    assert got == [(0, True), (0, True), (3, False), (3, False), (3, False), (3, False)]
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in [*rows, (6, " ".join(w))]], SCHEMA)
    assert sorted((r.doc_id for r in one_of_each_group(df).collect()), key=repr) == [5, *[None] * 5]


def test_one_of_each_group_keeps_columns_and_clean_documents(spark):
    rows = corpus(3, 80, [(10, 2)])
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA)
    left = one_of_each_group(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({g for _, _, g in brute(rows)})
    assert one_of_each_group(df.limit(0)).count() == 0


def test_minima_agree_as_often_as_sets_overlap():
    a, b = (shingles(" ".join(f"w{i}" for i in range(s, s + 400))) for s in (0, 40))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minima(a) == minima(b)).mean() - j) < 0.2
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a")) == 1 and len(shingles(None)) == 0


def test_runs_reach_the_recall():
    for deepest in (1, 3, 6):
        n, levels = plan_runs(0.8, TARGET_RECALL, deepest)
        assert levels == deepest and miss(0.8, COORDINATES // n, deepest) ** n <= 1 - TARGET_RECALL
    assert plan_runs(0.8, TARGET_RECALL, 6)[0] == 5 and plan_runs(0.6, TARGET_RECALL, 6)[1] < 6
    with pytest.raises(ValueError):
        plan_runs(0.1, TARGET_RECALL, 6)


def test_miss_is_what_sampling_loses():
    """The formula against the sampling itself: a tree over one pool of coordinates."""
    r, pool, deepest, n = random.Random(5), 12, 4, 20_000

    def found(agree, left, free):
        if not left:
            return True
        return any(c in agree and found(agree, left - 1, [x for x in free if x != c]) for c in r.sample(free, 2))

    lost = sum(not found({c for c in range(pool) if r.random() < 0.8}, deepest, list(range(pool))) for _ in range(n))
    assert abs(lost / n - miss(0.8, pool, deepest)) < 0.01


def test_rows_of_near_copies_are_in_proportion(spark):
    """Twice as many near copies make twice as many rows in buckets and tasks, and every link is found."""
    import sparkloom.llm.ngram_join as module

    base, counts = [f"w{i}" for i in range(60)], []
    for n in (1000, 2000):
        seen = {}
        search = module._candidates

        def counted(rows, threshold, _search=search, _seen=seen):
            _seen["rows"] = rows.count()
            return _search(rows, threshold)

        module._candidates = counted
        try:
            rows = [(i, " ".join(w if j != i % 50 + 5 else f"x{i}" for j, w in enumerate(base))) for i in range(n)]
            got = {x.doc_id: (x.n_links, x.group_id) for x in run(spark, rows).collect()}
        finally:
            module._candidates = search
        counts.append(seen["rows"])
        # sets with a word of their own in the same or the next place are linked (51 of 61, 50 of 62), others are not (49 of 63)
        assert got == {i: (n // 50 * (2 if i % 50 in (0, 49) else 3) - 1, 0) for i in range(n)}
    assert counts[1] < 2.6 * counts[0]


def test_extra_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id long, text string, gone int, _gone int")
    assert [tuple(r) for r in one_of_each_group(df).collect()] == [(1, "a b c d e f", 7, 8)]
