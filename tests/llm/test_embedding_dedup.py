import numpy as np

from sparkloom.llm.embedding_dedup import ego_join, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, links int"


def brute(rows, threshold=0.98):
    ok = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], dtype=np.float32).astype(float), np.array(rows[j][1], dtype=np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    if p != q:
                        parent[max(p, q, key=lambda k: rows[k][0])] = min(p, q, key=lambda k: rows[k][0])
    return {r[0]: (links[i], rows[find(i)][0]) for i, r in enumerate(rows)}


def test_against_brute_force_with_hot_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(420):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(6)]
        v = c + rng.standard_normal(12) * (0.12 if i % 2 else 0.4)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], int(i % 2), "k", 1))
    rows += [(1000 + i, rows[0][1], 0, "k", 1) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, SCHEMA), block=32).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0], [1.0, None], [inf, 1.0], [nan, 1.0]]
    rows = [(i, v, 1, "k", 1) for i, v in enumerate(odd)] + [(20, [1.0, 0.0], None, "k", 1), (21, [1.0, 0.0], 1, "k", 1), (22, [2.0, 0.0], 1, "k", 1), (23, [1.0, 0.0, 0.0], 1, "k", 1), (24, [1e-30, 0.0], 1, "k", 1), (25, [-1.0, 0.0], 1, "k", 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (0, i, True) for i in (*range(6), 20, 23, 25))
    assert got[21] == (2, 21, True) and got[22] == (2, 21, False) and got[24] == (2, 21, False)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_vectors(spark.createDataFrame(rows[:3], SCHEMA)).count() == 3
    twice = near_vectors(spark.createDataFrame([rows[7], rows[7]], SCHEMA)).collect()
    assert [(r.vec_id, r.n_links) for r in twice] == [(21, 1), (21, 1)]


def test_recursion_finds_what_a_full_comparison_finds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[np.lexsort(np.floor(x / 0.2).T[::-1])]
    axes = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    pairs = lambda *a, **b: sorted(map(tuple, np.concatenate([np.stack(p, 1) for p in ego_join(*a, leaf=8, **b)])))
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert pairs(x, x, axes, 0.2, 0.98, True) == pairs(x, x, axes, 0.2, 0.98, True, most=7) == sorted(map(tuple, want)) and len(want)
    assert pairs(x[:150], x[150:], axes, 0.2, 0.98, False) == sorted(map(tuple, np.argwhere(x[:150] @ x[150:].T >= 0.98)))


def test_blocks_that_are_apart_do_not_meet(spark):
    """Vectors along a circle: blocks meet their neighbours only, so pairs of blocks grow as blocks do."""
    from sparkloom.llm import embedding_dedup as module

    counts = []
    for n in (2000, 4000):
        seen, kept = [], module._block_pairs

        def counted(blocks, eps, _kept=kept, _seen=seen):
            out = _kept(blocks, eps)
            _seen += [blocks.count(), out.count()]
            return out

        module._block_pairs = counted
        try:
            rows = [(i, [float(np.cos(6.28 * i / n)), float(np.sin(6.28 * i / n)), 0.01], 1, "k", 1) for i in range(n)]
            got = near_vectors(spark.createDataFrame(rows, SCHEMA), block=32).agg({"n_links": "min", "component_id": "max"}).first()
        finally:
            module._block_pairs = kept
        assert min(got) == 0 and max(got) > 0.03 * n * 2
        counts.append(seen)
    (blocks, pairs), (more, double) = counts
    assert pairs < 0.3 * blocks * blocks and double < 0.3 * more * more
