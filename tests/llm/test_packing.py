import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.packing import WordIds, _first_bound, _second_bound, _solve, complete_bins, pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return WordIds(PATH, most=200)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab'sSTD.,1²½éÉ ß\n\t_-<|>", max_size=60)))
def test_ids_are_the_tokenizers(words, text):
    assert np.frombuffer(words(text), dtype="<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> hi", "don't IT'S ''s", "a\x85b\xa0c\x1cd", "İstanbul ǅ", "日本 x", "ﬁ é"])
def test_ids_of_odd_texts(words, text):
    assert np.frombuffer(words(text), dtype="<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    """The optimum by exhaustive search."""
    for bins in range(1, len(items) + 1):
        for where in itertools.product(range(bins), repeat=len(items)):
            load = [0] * bins
            for w, x in zip(where, items, strict=True):
                load[w] += x
            if max(load) <= capacity:
                return bins
    return 0


def optimum(items, capacity):
    """The same by sets of pieces, for more of them: sequences used and load of the open one."""
    left = {0: (0, capacity)}
    for s in range(1, 1 << len(items)):
        left[s] = min((n + 1, x) if load + x > capacity else (n, load + x) for i, x in enumerate(items) if s >> i & 1 for n, load in [left[s & ~(1 << i)]])
    return left[(1 << len(items)) - 1][0]


def used(patterns):
    out = collections.Counter()
    for p in patterns:
        for k, n in p.lengths:
            out[k] += n * p.times
    return out


def test_near_the_optimum_on_small_cases():
    r = random.Random(5)
    for _ in range(40):
        items = [r.randint(1, 12) for _ in range(6)]
        found = complete_bins(collections.Counter(items), 15)
        assert used(found) == collections.Counter(items) and all(sum(k * n for k, n in p.lengths) <= 15 for p in found)
        assert sum(p.times for p in found) <= fewest(items, 15) + (1 if r else 0)


def test_completion_beats_best_fit_decreasing():
    r = random.Random(3000)
    hist = collections.Counter(r.randint(300, 1200) for _ in range(3000))
    found, plain = complete_bins(hist), _solve(hist, 2048, 0)
    assert used(found) == hist and sum(p.times for p in found) < sum(p.times for p in plain)
    assert sum(p.times for p in found) <= 1.01 * _first_bound(hist, 2048)


def test_second_bound_is_a_bound():
    r = random.Random(8)
    better = 0
    for _ in range(60):
        hist = collections.Counter(r.randint(1, 20) for _ in range(7))
        bound = _second_bound(hist, 20)
        assert bound <= fewest([*hist.elements()], 20)
        better += bound > _first_bound(hist, 20)
    assert better


def test_documents_are_packed_better_than_by_best_fit(spark):
    """Through the operator itself: tables on which best fit decreasing needs a sequence more than the search."""
    from sparkloom.llm.packing import _best_fit_decreasing

    r, met = random.Random(21), 0
    while met < 3:
        lengths = [r.randint(3, 20) for _ in range(11)]
        plain = sum(p.times for p in _best_fit_decreasing(collections.Counter(lengths), 30))
        if plain == optimum(lengths, 30):
            continue
        met += 1
        docs = spark.createDataFrame([(i, "x " * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string")
        got = pack_documents(docs, PATH, capacity=30).collect()
        assert sorted(x.length for x in got) == sorted(lengths) and len({x.sequence_id for x in got}) == plain - 1


def test_small_cases_are_solved_to_the_optimum():
    r, greedy_misses = random.Random(11), 0
    for _ in range(400):
        items = [r.randint(3, 20) for _ in range(11)]
        hist = collections.Counter(items)
        found = complete_bins(hist, 30)
        want = optimum(items, 30)
        assert used(found) == hist and all(sum(k * n for k, n in p.lengths) <= 30 for p in found)
        assert sum(p.times for p in found) == want
        greedy_misses += sum(p.times for p in _solve(hist, 30, 2000)) > want
    assert greedy_misses


def test_the_incumbent_is_best_fit_decreasing():
    from sparkloom.llm.packing import _best_fit_decreasing

    r = random.Random(3)
    for _ in range(200):
        items = [r.randint(1, 40) for _ in range(60)]
        room = []
        for x in sorted(items, reverse=True):
            fits = [i for i, left in enumerate(room) if left >= x]
            at = min(fits, key=lambda i: room[i]) if fits else len(room)
            room[at:] = [room[at] - x, *room[at + 1 :]] if fits else [50 - x]
        found = _best_fit_decreasing(collections.Counter(items), 50)
        assert used(found) == collections.Counter(items)
        assert sorted(50 - sum(k * n for k, n in p.lengths) for p in found for _ in range(p.times)) == sorted(room)


def test_work_does_not_grow_with_counts():
    hist = {k: 10**9 + k for k in range(1, 400)}
    found = complete_bins(hist, 512)
    assert used(found) == hist and len(found) < 4000


def test_documents(spark):
    rows = [(1, "Hello world " * 3000, 1), (2, None, 1), (3, "", 1), (None, "abc", 1), (4, "a b c", 1), (4, "a b c", 1)] + [(10 + i, "same text here", 1) for i in range(200)] + [(300 + i, "x " * (i * 7 % 900), 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, PATH, with_ids=True).collect()
    tokenizer = WordIds(PATH).tokenizer
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[(i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert pack_documents(docs.limit(0), PATH).count() == 0
