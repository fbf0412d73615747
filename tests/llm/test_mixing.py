import collections

import numpy as np
import pyarrow.parquet as pq
import pytest

import xxhash

from sparkloom.llm import mixing
from sparkloom.llm.mixing import SEED, measured, mix, mixed_documents, mixture, source_table, splitting_tree, targets

SCHEMA = "doc_id long, text string, source string, lang string, size int"


def test_targets_share_caps_and_reshare():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and got[1] == pytest.approx(120) and got[2] == pytest.approx(60)
    assert targets([], []) == [] and targets([0, 0], [5, 2]) == [0, 0]
    r = np.random.default_rng(0)
    for _ in range(50):
        sizes, weights = r.integers(0, 100, 8).tolist(), [5, 2, 1, 5, 2, 1, 5, 2]
        t = targets(sizes, weights)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
        free = [(x / w) for x, s, w in zip(t, sizes, weights, strict=True) if x < 3 * s - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))


def test_tree_is_exact_and_even():
    q = np.array([1000, 37, 0, 5])
    for shards in (1, 2, 7, 16):
        got = list(splitting_tree(q, q * 0, 0, shards, 1))
        counts, firsts = np.array([g[3] for g in got]), np.array([g[2] for g in got])
        assert [g[:2] for g in got] == [(i, i + 1) for i in range(shards)]
        assert (counts.sum(0) == q).all() and counts.sum(1).max() - counts.sum(1).min() <= shards.bit_length()
        assert (firsts == np.cumsum(counts, 0) - counts).all()
        # subtrees, expanded apart from each other, give the same leaves
        again = [x for low, high, first, quota in splitting_tree(q, q * 0, 0, shards, 1, 3) for x in splitting_tree(quota, first, low, high, 1)]
        assert repr(again) == repr(got)


def xx(*values):
    """Spark's xxhash64 of columns: ints of 32 bits as ("i", n), longs as numbers."""
    h = 42
    for v in values:
        if v is not None:
            data = v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, block_words, shard_words, documents_stay_whole=False):
    """(doc_id, size, taken, places) of each row by the definition, block by block and document by document."""
    size = lambda t: len([w for w in (t or "").replace("\x1c", "x").split()])
    count = collections.Counter((i, s, size(t), xx(t)) for i, t, s in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n * k[2] for k, n in count.items() if k[1] == s) for s in names}
    goal = dict(zip(names, targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    blocks, ranked, quota = {}, {}, []
    for at, s in enumerate(names):
        n = max(1, -(-total[s] // block_words))
        held = collections.defaultdict(list)
        for k in count:
            if k[1] == s and k[2]:
                held[xx(("i", SEED), k[0], k[2], k[3]) % n].append(k)
        order = lambda b: ((key := xx(("i", SEED), ("i", at), b)) >> 20) % mixing.BINS * (1 << 70) + key  # noqa: B023, E731
        blocks[s], ranked[s] = held, sorted(held, key=order)
        whole = min(round(goal[s]) // total[s], 3) if total[s] else 0
        rest = round(goal[s]) - whole * total[s]
        some = min(len(held), max(1, n * rest // total[s]) if rest else 0)
        quota.append((s, whole, rest, some))
    quota = [q for q in quota if blocks[q[0]]]
    q = np.array([whole * len(blocks[s]) + some for s, whole, _, some in quota])
    taken, places = collections.defaultdict(list), collections.defaultdict(list)
    shards = max(1, round(sum(goal[s] for s, *_ in quota) / shard_words))
    for shard, _, first, here in splitting_tree(q, q * 0, 0, shards, SEED):
        found = []
        for (s, whole, rest, some), a, n in zip(quota, first.tolist(), here.tolist(), strict=True):
            words = lambda b: sum(k[2] * count[k] for k in blocks[s][b])  # noqa: B023, E731
            b, full = len(blocks[s]), whole * len(blocks[s])
            picks = [(p // b, ranked[s][p % b], None) for p in range(a, min(a + n, full))]
            if a + n > full:
                low, high = max(a - full, 0) * b // some, (a + n - full) * b // some
                before = [sum(map(words, ranked[s][:r])) for r in (low, high)]
                left = rest * before[1] // total[s] - rest * before[0] // total[s]
                for r in range(low, high):
                    picks.append((whole, ranked[s][r], max(0, left)))
                    left -= words(ranked[s][r])
            for turn, block, left in picks:
                for k in sorted(blocks[s][block], key=lambda k: xx(("i", SEED), k[0], k[2], k[3])):
                    w = k[2] * count[k] if left is None else max(0, min(left, k[2] * count[k]))
                    if documents_stay_whole:  # the nearer number of whole documents
                        w = (2 * w + k[2]) // (2 * k[2]) * k[2]
                    left = None if left is None else left - k[2] * count[k]
                    if w:
                        found.append((xx(("i", SEED), k[0], ("i", turn), k[2], k[3]), k, turn, w))
        position = 1
        for _, k, turn, w in sorted(found, key=lambda x: (x[0], x[2])):
            for row in range(-(-w // k[2])):
                taken[k, row].append(min(k[2], w - row * k[2]))
                places[k, row].append((turn, shard, position))
                position += 1
    return sorted(((k[0], k[2], sum(taken[k, r]), [p[1:] for p in sorted(places[k, r])]) for k, n in count.items() for r in range(n)), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 9) for i, t, s in rows], SCHEMA)


def sample(spark):
    rows = [(i, "w " * (i % 40), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    return rows, documents(spark, [*rows, (None, "a b c", None), (9000, None, "s1"), (9001, "", None), (9002, "x " * 5000, "s2")])


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 6000)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)


def rows_of(found):
    return sorted(((r.doc_id, r["size"], r.taken, list(zip(r.shard, r.position, strict=True))) for r in found.collect()), key=repr)


def test_against_brute_force(spark, small_blocks):
    rows, _ = sample(spark)
    rows = [*rows, (None, "a b c", None), (None, "a b d", None), (9000, None, "s1"), (9001, "", None), (9002, "x " * 5000, "s2"), *rows[5:9] * 3]
    got = rows_of(mixture(documents(spark, rows)))
    assert got == plain_mix(rows, 300, 6000) and len(got) == len(rows)


def test_each_source_meets_its_target_exactly(spark):
    _, docs = sample(spark)
    sized = measured(docs).cache()
    sources = source_table(sized)
    taken = collections.Counter()
    per_doc = collections.Counter()
    for r in mix(sized, sources).collect():
        taken[r.source] += r.words
        per_doc[r.doc_id] += r.words
        assert 0 < r.words <= r["size"]
    table = {r.source: r for r in sources.collect()}
    assert {s: taken[s] for s in table} == {s: round(r.target) for s, r in table.items()}
    size = {r.doc_id: r["size"] for r in sized.collect()}
    assert all(n <= 3 * size[i] for i, n in per_doc.items())
    order = sorted((s for s in table if s is not None)) + [None]
    assert [table[s].target / {0: 5, 1: 2, 2: 1}[i % 3] for i, s in enumerate(order) if table[s].target < 3 * table[s].source_size - 1]


def test_the_tree_decides_what_is_taken(spark, small_blocks, monkeypatch):
    _, docs = sample(spark)
    found = mixture(docs).collect()
    taken = {(r.doc_id, r["size"]): r.taken for r in found}
    monkeypatch.setattr(mixing, "halves", lambda quotas, low, high, seed: ((low + high) // 2, quotas * 0))  # all blocks to the last shard
    other = mixture(docs).collect()
    changed = [r for r in other if r.taken != taken[r.doc_id, r["size"]]]
    assert len(changed) > 50
    assert sum(r.taken for r in other) == sum(r.taken for r in found)  # the targets are met either way
    monkeypatch.undo()


def test_shards_are_disjoint_shuffled_and_even(spark, small_blocks):
    _, docs = sample(spark)
    sized = measured(docs).cache()
    sources = source_table(sized)
    rows = mix(sized, sources).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix(sized, sources).collect()), key=repr)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert len(shards) > 5 and max(map(len, shards.values())) < 3 * min(map(len, shards.values()))
    for part in shards.values():
        assert sorted(r.position for r in part) == list(range(1, len(part) + 1))
    # a block of one pass lies in one shard: no document of a pass is there twice
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)


def test_documents_of_the_mix(spark):
    rows, docs = sample(spark)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    times = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
        times[r.doc_id] += 1
    for r in source_table(measured(docs)).collect():
        biggest = 5000 if r.source == "s2" else 40
        assert abs(words[r.source] - r.target) <= biggest
    assert max(times.values()) <= 3


def test_documents_are_written_in_the_order_of_shards(spark, tmp_path, small_blocks):
    _, docs = sample(spark)
    sized = measured(docs).cache()
    order = sorted((r.shard, r.position, r.doc_id) for r in mix(sized, source_table(sized), whole=True).collect())
    mixed_documents(docs).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    found = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert found == [i for *_, i in order] and found != sorted(found, key=lambda i: (i is None, i or 0))


def test_repeated_rows_come_near_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b c d e f g h i j", "s0")] * 60 + [(i, "x y z " * 9, "s1") for i in range(2, 40)]
    docs = documents(spark, rows)
    target = {r.source: r.target for r in source_table(measured(docs)).collect()}
    words = collections.Counter()
    for r in mixed_documents(docs).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target[s]) <= 14 for s in target)
    assert rows_of(mixture(docs)) == plain_mix(rows, mixing.BLOCK_WORDS, mixing.SHARD_WORDS)


def test_extra_columns_may_have_any_name(spark):
    names = ("entry", "_entry", "row", "placed", "turn", "shard", "position", "mark", "size")
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, "a b c", "s", *[i] * len(names)) for i in range(9)], schema)
    found = mixed_documents(docs)
    assert found.columns == docs.columns and found.count() == 9


def test_empty_and_repeated(spark):
    assert mixed_documents(documents(spark, [])).count() == 0
    sized = measured(documents(spark, []))
    assert mix(sized, source_table(sized)).count() == 0
    assert mixed_documents(documents(spark, [(1, None, None), (2, "", "s")])).count() == 0
    assert mixed_documents(documents(spark, [(1, "a b", "s"), (1, "a b", "s")])).count() == 2
    assert [r["size"] for r in measured(documents(spark, [(1, " a\tb\x0bc d\x0ce ", "s")])).collect()] == [4]
