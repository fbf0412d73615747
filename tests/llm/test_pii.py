import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pii


def plain(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [(0, *m.span()) for m in email.finditer(text)]
    out += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in card.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in phone.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 1059()é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["x 4111111111111111 y", "a.b@c.de, f@g.hi", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8 0255.1.1.256", "+1 (743) 555-3824 +12", "12345.1.1.1.1 001.2.3.0004", "+1+22222222(", "4111-1111-1111-1111 ", "é" * 50 + "x@y.zz"])
def test_base_spans_of_known_texts(text):
    assert pii.base_spans(text) == plain(text)


def test_gradient():
    rng = np.random.default_rng(0)
    m = pii.BiLstmCrf()
    x, n, y = rng.integers(1, pii._CLASSES, (3, 9)).astype(np.uint8), np.array([9, 5, 7]), rng.integers(0, 5, (3, 9))
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    _, grad = m.loss_and_grad(x, n, y)
    for k in m.p:
        i = tuple(rng.integers(0, s) for s in m.p[k].shape)
        old, eps = m.p[k][i], 1e-4
        m.p[k][i] = old + eps
        up = m.loss_and_grad(x, n, y)[0]
        m.p[k][i] = old - eps
        down = m.loss_and_grad(x, n, y)[0]
        m.p[k][i] = old
        assert abs((up - down) / (2 * eps) - grad[k][i]) < 1e-3 + 0.02 * abs(grad[k][i])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    m = pii.BiLstmCrf()
    m.p["trans"] = rng.standard_normal((5, 5)).astype(np.float32)
    x, n = rng.integers(1, pii._CLASSES, (4, 4)).astype(np.uint8), np.array([4, 3, 2, 4])
    mask = np.arange(4)[None] < n[:, None]
    e = m.emissions(x, mask)
    for row, tags in enumerate(m.decode(x, n)):
        def score(path, row=row):
            return e[0, row, path[0]] + m.p["start"][path[0]] + sum(m.p["trans"][a, b] + e[t + 1, row, b] for t, (a, b) in enumerate(zip(path, path[1:], strict=False)))

        best = max((score(p) for p in np.ndindex(*[5] * n[row])))
        assert abs(score(tuple(tags[: n[row]])) - best) < 1e-4


def test_decoding_equals_the_plain_way():
    """Whole texts of one window and of many, against Viterbi over the emissions that training uses."""
    rng = np.random.default_rng(2)
    m = pii.BiLstmCrf()
    for k in m.p:
        m.p[k] = (m.p[k] + 0.5 * rng.standard_normal(m.p[k].shape)).astype(np.float32)
    n = np.array([40, 40, 33, 7, 1])
    x = np.where(np.arange(40)[None] < n[:, None], rng.integers(1, pii._CLASSES, (5, 40)), 0).astype(np.uint8)
    got = m.decode(x, n)
    e = m.emissions(x, np.arange(40)[None] < n[:, None])
    for row in range(5):
        score, back = e[0, row] + m.p["start"], []
        for t in range(1, n[row]):
            to = score[:, None] + m.p["trans"]
            back.append(to.argmax(0))
            score = to.max(0) + e[t, row]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert path[::-1] == got[row, : n[row]].tolist() and not got[row, n[row] :].any()
    assert len(np.unique(got)) > 2


def test_windows_without_a_path_to_trace_have_no_span():
    """The bound that spares windows the search for their best path never leaves out one with a span."""
    rng = np.random.default_rng(4)
    spared = traced = 0
    for lean in (-2, 0, 2, 4, 6):
        m = pii.BiLstmCrf(int(rng.integers(99)))
        for k in m.p:
            m.p[k] = (m.p[k] + 0.7 * rng.standard_normal(m.p[k].shape)).astype(np.float32)
        m.p["bias"][0] += lean
        n = np.sort(rng.integers(1, 60, 300))
        x = np.where(np.arange(n[-1])[None] < n[:, None], rng.integers(1, pii._CLASSES, (300, n[-1])), 0).astype(np.uint8)
        e = m._emissions(x, n)
        every = m._best_paths(e, n)
        assert (m.decode(x, n) == every).all()
        possible = m._spans_possible(e, n)
        assert not every[~possible].any()
        spared, traced = spared + int((~possible).sum()), traced + int(every.any(1).sum())
    assert spared > 100 and traced > 100


def test_decoding_takes_little_more_than_its_products():
    """CPU time of windows without data, against that of the products and tanh that no way of reading them can leave out."""
    import time

    rng = np.random.default_rng(6)
    m = pii.BiLstmCrf()
    m.p["bias"][0] = 6
    x, n = rng.integers(1, pii._CLASSES, (768, 128)).astype(np.uint8), np.full(768, 128)
    w, state, g = (rng.standard_normal(s).astype(np.float32) for s in ((48, 22), (22, 768), (60, 768)))

    def least():
        for _ in range(2 * 128):  # both directions
            np.matmul(w, state, out=g[:48])
            np.tanh(g, out=g)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    runs = [(seconds(lambda: m.decode(x, n)), seconds(least)) for _ in range(7)]
    assert not m.decode(x, n).any()
    took, bare = (min(r) for r in zip(*runs, strict=True))
    assert took < 2.7 * bare, (took, bare)


def test_searches_skip_to_digits():
    """CPU time of the IP pattern on text without digits, against a search for a digit; and what it finds after runs of them."""
    import time

    text, digit = "some words, and no number at all " * 30_000, re.compile("[0-9]")

    def seconds(pattern):
        began = time.process_time()
        assert not pattern.search(text)
        return time.process_time() - began

    took, bare = (min(r) for r in zip(*[(seconds(pii._IP), seconds(digit)) for _ in range(7)], strict=True))
    assert took < 2 * bare, (took, bare)
    for found in ("11.2.3.4", "x1.2.3.45.6.7.8", "1.2.3.4.5.6.7.8.9", "12345.1.1.1", "1.1.1.1 2.2.2.2", "..1.2.3.4", "1.2.3.4"):
        assert [m.span() for m in pii._IP.finditer(found)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", found)]


@pytest.fixture(scope="module")
def learned(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet").where("doc_id % 2 = 0")
    return pii.train(pii.sample_texts(docs, 1500))


def held_out(spark, sf):
    return [r.text for r in spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet").where("doc_id % 2 = 1 and text rlike '[0-9@]'").limit(1500).collect()]


def test_network_finds_held_out_spans(spark, sf, learned):
    texts = held_out(spark, sf)
    base = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(learned, texts, [[] for _ in texts])
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, base, strict=True))
    assert hit / sum(map(len, base)) > 0.95 and hit / sum(map(len, found)) > 0.98
    text = "on the other 4111111111111111 4111111111111111 thing in re"
    assert pii.base_spans(text) == [] and pii.added_spans(learned, [text], [[]])[0] == [(2, 13, 29), (2, 30, 46)]


def test_network_adds_what_the_patterns_miss(spark, sf, learned):
    """Held-out data in spellings that no pattern matches, in held-out texts; and numbers that are no personal data."""
    rng, texts, truth, found = np.random.default_rng(11), held_out(spark, sf), 0, []
    for text in texts:
        spans = pii.base_spans(text)
        if len(spans) != 1:
            continue
        kind, a, b = spans[0]
        at, want, parts = a, set(), pii.respelled(kind, text[a:b], rng)
        for part, tag in parts:
            if tag and pii.plausible(kind, part):
                want.add((kind, at, at + len(part)))
            at += len(part)
        text = text[:a] + "".join(t for t, _ in parts) + text[b:]
        base = pii.base_spans(text)
        want -= set(base)
        got = set(pii.added_spans(learned, [text], [base])[0])
        truth += len(want)
        found += [x in want for x in got]
    assert truth > 80 and sum(found) / truth > 0.9 and sum(found) / len(found) > 0.95
    clean = [t[:100] + " " + pii.decoy(rng) + " " + t[100:] for t in texts if not pii.base_spans(t)]
    wrong = sum(len(x) for x in pii.added_spans(learned, clean, [pii.base_spans(t) for t in clean]))
    assert wrong <= len(clean) / 50


def test_windows_cover_every_character():
    rng = np.random.default_rng(0)
    for n in (0, 1, 80, pii.WINDOW, pii.WINDOW + 1, 1000, 5000):
        windows = pii.windows_of(n)
        covered = np.zeros(n, dtype=bool)
        for a, b in windows:
            assert 0 <= a < b <= n and b - a == min(n, pii.WINDOW)
            covered[a:b] = True
        assert covered.all()
        if n:
            # the deepest window decides
            rows = [rng.integers(0, 5, b - a).astype(np.int8) for a, b in windows]
            depth = lambda at, w: min(at - w[0] if w[0] else pii.WINDOW, w[1] - 1 - at if w[1] < n else pii.WINDOW)  # noqa: B023, E731
            got = pii.reconciled(windows, rows)
            for at in range(n):
                inside = [(depth(at, w), row[at - w[0]]) for w, row in zip(windows, rows, strict=True) if w[0] <= at < w[1]]
                assert got[at] in [tag for d, tag in inside if d >= max(inside)[0] - 1]


def test_query_against_the_patterns(spark, sf):
    import hashlib

    from sparkloom.llm.queries import op3_pii

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(plain(texts[r.doc_id]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
        spelled = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(",")) | ({""} if not spelled else set())


def test_query_adds_spans(spark, sf):
    """On a larger table: what it adds is what the patterns miss, and right."""
    from sparkloom.llm.queries import op3_pii

    folder = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    added = [(texts[r.doc_id], x.split(":")) for r in op3_pii(spark, folder).where("n_added > 0").collect() for x in r.spans.split(",")]
    added = [(kind, text[int(a) : int(b)]) for text, (kind, a, b) in added if (pii.KINDS.index(kind), int(a), int(b)) not in plain(text)]
    assert added and all(pii.plausible(pii.KINDS.index(kind), found) for kind, found in added)


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1" * 200_000, "1" * 50_000 + "." + "2" * 50_000 + ".3", "+" * 100_000, "a@" * 50_000, "1 " * 100_000])
def test_long_runs_take_time_in_proportion(text):
    import time

    began = time.process_time()
    assert pii.base_spans(text) == ([(1, 0, 5006)] if text.startswith("00") else [])
    assert time.process_time() - began < 2


def test_edge_cases(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "a@b.cc " * 20_000, "k"), (None, "1.2.3.4", "k"), (4, "no data", "k"), (4, "no data", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.find_personal_data(docs, epochs=1).collect()
    assert len(got) == 6 and {r.doc_id: len(r.base) for r in got} == {1: 0, 2: 0, 3: 20_000, None: 1, 4: 0}
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    assert pii.find_personal_data(docs.where("doc_id = 4")).count() == 2
