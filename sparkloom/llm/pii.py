"""Personal data: exact base detectors, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from four patterns, leftmost and non-overlapping per kind, checked after matching (IP parts, card
length and Luhn, phone digits); what fails is dropped without another try.  The network adds spans of the same kinds
in spellings that the patterns miss (``jane [at] example [dot] com``, ``192[.]0[.]2[.]7``, card numbers cut by other
signs or run together, phone numbers without a plus); it never removes a base span.

The network reads every character of every text, in overlapping windows of ``WINDOW`` characters.  Windows of a whole
batch of documents are decoded together (Viterbi over the CRF; where an upper bound shows that no path with a span can
be the best, none is traced), then reconciled globally in each document: a character takes its tag from the window in
which it lies deepest.  A run of one tag is added if it overlaps no base span and its usual spelling (``usual``) passes
its kind's checks (``plausible``).

Training is plain numpy (backpropagation through time, CRF forward-backward, Adam) on a bounded sample: the
``most_docs`` documents with the smallest hash of their doc_id among those with a digit or an '@' (texts are read
whole when they are labelled; ``MOST_SPANS`` spans of a text and ``MOST_WINDOWS`` windows in all are fitted).  Labels
are the shapes of the base patterns, the same data respelled (``respelled``), and windows without any: other text of
the sample, and numbers that are no personal data (``decoy``).

Defined results: null text counts as empty; very long texts are read whole; with no span in the sample there is no
network and only base spans are found, as in an empty table; ties of equal doc_id and text are the same row to the
sample; rows that repeat a doc_id are read one by one; other columns are ignored; offsets are code points, the end
exclusive.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import prepare, thinned

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1  # 0 is "outside"
#: Characters of a window, shared by neighbours, and of a window in training.
WINDOW, OVERLAP, FITTED = 256, 32, 80
HIDDEN, EMBED = 12, 10
#: Windows that are decoded together: their states stay in the cache, and the product below OpenBLAS's bound for small ones.
BLOCK = 768
MOST_DOCS = 1500
MOST_SPANS = 8
MOST_WINDOWS = 4000
RESPELLED, ROUNDS = 4, 8
EPOCHS = 12

# --------------------------------------------------------------------------- base detectors

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never begins within a run of digits; the first digit stands before what says so, as searches skip to it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from each '@' outwards: the same spans, without a scan of every word."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_parts(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]  # of any length
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _byte_parts(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --------------------------------------------------------------------------- characters and windows

_SIGNS = " \n\t.,;:!?@%+-_()[]{}<>/\\|'\"#$&*=~"
#: Padding, digit, other letter, other; then letters of either case; then signs.
_CLASSES = 4 + 26 + len(_SIGNS)


def _class_of(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if c.isascii() and c.isalpha():
        return 4 + ord(c.lower()) - ord("a")
    return 30 + _SIGNS.index(c) if c in _SIGNS else 2 if c.isalpha() else 3


_TABLE = np.array([*(_class_of(chr(c)) for c in range(0x250)), 2], dtype=np.uint8)  # the last one is that of all others


def char_classes(text: str) -> np.ndarray:
    if text.isascii():
        return _TABLE[np.frombuffer(text.encode(), dtype=np.uint8)]
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(_TABLE) - 1)]


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over a text of n characters; the last one ends with it."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    return [(a, a + WINDOW) for a in [*range(0, n - WINDOW, WINDOW - OVERLAP), n - WINDOW]]


def reconciled(windows: list[tuple[int, int]], rows: list[np.ndarray]) -> np.ndarray:
    """A text's tags: each character's from the window in which it lies deepest, so windows change in mid-overlap."""
    cuts = [(b + a) // 2 for (_, b), (a, _) in itertools.pairwise(windows)]
    edges = itertools.pairwise([0, *cuts, windows[-1][1]])
    return np.concatenate([row[x - a : y - a] for row, (a, _), (x, y) in zip(rows, windows, edges, strict=True)])


# --------------------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _aligned(*shape: int) -> np.ndarray:
    """Zeros that begin with a line of the cache, which arithmetic on whole vectors is faster on."""
    size = 4 * int(np.prod(shape))
    raw = np.zeros(size + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + size].view(np.float32).reshape(shape)


class BiLstmCrf:
    """One LSTM layer each way, linear emissions, first-order CRF."""

    NAMES = ("embed", "fx", "fh", "fb", "bx", "bh", "bb", "out", "bias", "trans", "start")

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        gate = np.zeros(4 * HIDDEN, dtype=np.float32)
        gate[HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p = {
            "embed": draw(_CLASSES, EMBED), "fx": draw(EMBED, 4 * HIDDEN), "fh": draw(HIDDEN, 4 * HIDDEN), "fb": gate.copy(), "bx": draw(EMBED, 4 * HIDDEN), "bh": draw(HIDDEN, 4 * HIDDEN), "bb": gate.copy(),
            "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32),
        }

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction (time first); what backpropagation needs goes to ``keep``."""
        steps, rows = x.shape
        inputs = self.p["embed"] @ self.p[d + "x"] + self.p[d + "b"]  # of each character class
        wh, h, c = self.p[d + "h"], np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        hs = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = inputs[x[t]] + h @ wh
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            hs[t] = h
        return hs

    def emissions(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        xt, mt = x.T, mask.T
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(xt, mt, "f", kf), self._run(xt, mt, "b", kb)], axis=2)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "both": both}
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Viterbi tags (windows x characters) of padded class ids."""
        e = self._emissions(x, n)
        tags = np.zeros(x.shape, dtype=np.int8)
        some = np.flatnonzero(self._spans_possible(e, n))
        if len(some):
            tags[some] = self._best_paths(np.ascontiguousarray(e[:, :, some]), n[some])
        return tags

    def _spans_possible(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a path with a span may score as high as the one without: an upper bound, never False if there is one.

        All kinds are taken as one tag, with the best emission and the best transitions of any.  ``ahead`` is by how much
        the best path that is within a span leads the path without any.
        """
        trans, start = self.p["trans"] - self.p["trans"][0, 0], self.p["start"] - self.p["start"][0]
        enter, stay, leave = float(trans[0, 1:].max()), float(trans[1:, 1:].max()), float(trans[1:, 0].max())
        lead = e[:, 1:].max(1) - e[:, 0]
        lead[np.arange(len(e))[:, None] >= n] = -1e9
        ahead = lead[0] + start[1:].max()
        most = ahead.copy()
        for now in lead[1:]:
            ahead += stay
            np.maximum(ahead, enter, out=ahead)
            ahead += now
            np.maximum(most, ahead, out=most)
        return most + max(leave, 0.0) > -0.01  # far above what rounding does

    def _best_paths(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        steps, _, rows = e.shape
        mask = np.arange(steps)[:, None] < n
        whole = mask.all(1)
        trans = self.p["trans"]
        scores = np.empty((steps, TAGS, rows), np.float32)
        scores[0] = e[0] + self.p["start"][:, None]
        for t in range(1, steps):
            before = scores[t - 1]
            best = (before[:, None] + trans[:, :, None]).max(0)
            best += e[t]
            scores[t] = best if whole[t] else np.where(mask[t], best, before)
        tags = np.zeros((rows, steps), dtype=np.int8)
        now = scores[-1].argmax(0)
        for t in range(steps - 1, -1, -1):
            tags[:, t] = now
            if t:
                last = (scores[t - 1] + trans[:, now]).argmax(0)
                now = last if whole[t] else np.where(mask[t], last, now)
        return np.where(mask.T, tags, 0).astype(np.int8)

    def _emissions(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Emissions (characters x tags x windows) without what training needs.

        The backward pass reads each window from its own end, so that no state has to be masked.  Windows are the last
        axis throughout: one product gives all gates, and each gate is a block of memory.
        """
        rows, steps = x.shape
        at = np.arange(steps)[None, :]
        even = bool((n == steps).all())
        turned = None if even else np.where(at < n[:, None], n[:, None] - 1 - at, at)  # its own inverse
        # a sigmoid is (1 + tanh of half the argument) / 2, and h is kept twice as large
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)[:, None]
        embed = np.ascontiguousarray(self.p["embed"].T)
        parts = []
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            weights = np.concatenate([self.p[d + "h"].T / 2, self.p[d + "x"].T, self.p[d + "b"][:, None]], axis=1) * half
            own = np.ascontiguousarray(self.p["out"][part].T / 2)
            read = x if d == "f" else x[:, ::-1] if turned is None else np.take_along_axis(x, turned, 1)
            ids = np.ascontiguousarray(read.T).astype(np.intp)
            state, g, c, p = (_aligned(k, rows) for k in (HIDDEN + EMBED + 1, 4 * HIDDEN, HIDDEN, HIDDEN))
            h, char, seen = state[:HIDDEN], state[HIDDEN:-1], np.empty((steps, TAGS, rows), np.float32)
            state[-1] = 1  # for the bias
            (i, f, o, u), sigmoids = g.reshape(4, HIDDEN, rows), g[: 3 * HIDDEN]
            for t in range(steps):
                embed.take(ids[t], axis=1, out=char, mode="clip")
                np.matmul(weights, state, out=g)
                np.tanh(g, out=g)
                sigmoids += 1
                c *= f
                np.multiply(i, u, out=p)
                c += p
                c *= 0.5
                np.tanh(c, out=p)
                np.multiply(o, p, out=h)
                np.matmul(own, h, out=seen[t])
            parts.append(seen)
        out, back = parts
        out += back[::-1] if turned is None else back[turned.T, :, np.arange(rows)].transpose(0, 2, 1)
        out += self.p["bias"][:, None]
        return out

    def loss_and_grad(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` and its gradient."""
        rows, steps = x.shape
        mask = np.arange(steps)[None, :] < n[:, None]
        keep: dict = {}
        e, mt, yt = self.emissions(x, mask, keep).astype(np.float64), mask.T, y.T
        trans, start = self.p["trans"].astype(np.float64), self.p["start"].astype(np.float64)
        lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
        alpha = np.zeros((steps, rows, TAGS))
        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = np.where(mt[t][:, None], lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t], alpha[t - 1])
        total = lse(alpha[-1], 1)
        beta = np.zeros((steps, rows, TAGS))
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mt[t + 1][:, None], lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        gold = e[0][np.arange(rows), yt[0]] + start[yt[0]]
        marginal = np.exp(alpha + beta - total[None, :, None]) * mt[:, :, None]
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            m = mt[t]
            gold += np.where(m, e[t][np.arange(rows), yt[t]] + trans[yt[t - 1], yt[t]], 0)
            pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            d_trans += pair[m].sum(0)
            np.subtract.at(d_trans, (yt[t - 1][m], yt[t][m]), 1)
        d_e = marginal.copy()
        tt, rr = np.nonzero(mt)
        d_e[tt, rr, yt[tt, rr]] -= 1
        d_e = (d_e / rows).astype(np.float32)
        d_start = marginal[0].sum(0)
        np.subtract.at(d_start, yt[0], 1)
        grad = {"trans": (d_trans / rows).astype(np.float32), "start": (d_start / rows).astype(np.float32)}
        flat = keep["both"].reshape(-1, 2 * HIDDEN)
        grad["out"], grad["bias"] = flat.T @ d_e.reshape(-1, TAGS), d_e.sum((0, 1))
        d_h = d_e @ self.p["out"].T
        grad["embed"] = np.zeros_like(self.p["embed"])
        for k, d in enumerate("fb"):
            self._back(x.T, keep[d], d, d_h[:, :, k * HIDDEN : (k + 1) * HIDDEN], grad)
        return float((total - gold).mean()), grad

    def _back(self, xt: np.ndarray, kept: list, d: str, d_out: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        wh = self.p[d + "h"]
        rows = xt.shape[1]
        dh, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        grad[d + "h"] = np.zeros_like(wh)
        by_class = np.zeros((_CLASSES, 4 * HIDDEN), np.float32)
        for t, h, c, i, f, o, u, tc, m in reversed(kept):
            dh = dh + d_out[t]
            through_h, through_c = np.where(m, 0, dh), np.where(m, 0, dc)
            gh = np.where(m, dh, 0)
            gc = np.where(m, dc, 0) + gh * o * (1 - tc * tc)
            g = np.concatenate([gc * u * i * (1 - i), gc * c * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - u * u)], axis=1)
            grad[d + "h"] += h.T @ g
            np.add.at(by_class, xt[t], g)
            dh, dc = g @ wh.T + through_h, gc * f + through_c
        grad[d + "b"] = by_class.sum(0)
        grad[d + "x"] = self.p["embed"].T @ by_class
        grad["embed"] += by_class @ self.p[d + "x"].T

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 64, seed: int = 9) -> list[float]:
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, losses = 0, []
        for epoch in range(epochs):
            order, seen = rng.permutation(len(x)), 0.0
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                width = int(n[rows].max())
                loss, grad = self.loss_and_grad(x[rows, :width], n[rows], y[rows, :width])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
                seen += loss * len(rows)
            losses.append(seen / len(order))
        return losses


# --------------------------------------------------------------------------- training sample and detection

_AT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*|\s+dot\s+|\s*\.\s*", re.I)


def usual(kind: int, found: str) -> str:
    """The usual spelling of what the network has found."""
    if kind == 0:
        return _DOT.sub(".", _AT.sub("@", found))
    if kind == 1:
        return _DOT.sub(".", found)
    return found


def plausible(kind: int, found: str) -> bool:
    """Whether an added span can be of its kind at all: the base checks of its usual spelling."""
    found = usual(kind, found)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", found))
    if kind == 1:
        return bool(_IP.fullmatch(found)) and all(len(p) <= 3 for p in found.split(".")) and _byte_parts(found)
    digits = _digits(found)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", found)) and 16 <= len(digits) <= 19 and luhn(digits)
    # a number without a plus needs an area code and two gaps
    return bool(re.fullmatch(r"[+(0-9][ ()./0-9-]+[0-9]", found)) and (8 if found[0] == "+" else 10) <= len(digits) <= 15 and (found[0] == "+" or len(re.findall(r"[ ()./-]+", found)) >= 2)


def shapes(text: str) -> list[tuple[int, int, int]]:
    """What the patterns match, whether it passes Luhn's check or not, as a network cannot sum up digits; and numbers of a card's length among others."""
    out = [x for x in base_spans(text) if x[0] != 2]
    for m in _CARD.finditer(text):
        if 16 <= (n := len(_digits(m[0]))) <= 19:
            out.append((2, *m.span()))
        elif n > 19:
            out += [(2, m.start() + r.start(), m.start() + r.end()) for r in re.finditer(r"(?<![0-9])[0-9]{16,19}(?![0-9])", m[0])]
    return out


def respelled(kind: int, found: str, rng: np.random.Generator) -> list[tuple[str, int]]:
    """Parts (text, tag) of a span in a spelling that the patterns miss."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    tag, digits = kind + 1, _digits(found)
    if kind == 0:
        local, _, domain = found.partition("@")
        at, dots = pick((" at ", (" dot ",)), (" [at] ", (" [dot] ", ".", " dot ")), ("[at]", ("[dot]", ".")), ("(at)", ("(dot)", ".")), (" (at) ", (" (dot) ", ".")), (" @ ", (".", " . ")), (" AT ", (" DOT ",)))
        return [(local + at + domain.replace(".", pick(*dots)), tag)]
    if kind == 1:
        return [(found.replace(".", pick("[.]", "(.)", " . ", "[dot]", " dot ")), tag)]
    if kind == 2:
        if rng.random() < 0.4:  # two numbers that the pattern reads as one
            return [(found, tag), (" ", 0), (found if rng.random() < 0.5 else _number(len(digits), rng), tag)]
        return [(pick(".", "/", "_", "  ", " - ").replace(" - ", "--").join(digits[i : i + 4] for i in range(0, len(digits), 4)), tag)]
    area, middle, end = digits[-10:-7] or "30", digits[-7:-4], digits[-4:]
    area = (area + "217")[:3]
    forms = ("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "1-{0}-{1}-{2}", "001 {0} {1} {2}", "{0}/{1}-{2}", "0{0} {1} {2}", "+1/{0}/{1}/{2}")
    return [(pick(*forms).format(area, middle, end), tag)]


def _number(n: int, rng: np.random.Generator) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def decoy(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    n = lambda low, high: int(rng.integers(low, high))
    forms = (
        lambda: f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", lambda: f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2030)} {n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}",
        lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 90)}", lambda: f"{n(0, 10**6):,}.{n(0, 100):02}", lambda: f"${n(1, 10**5)}", lambda: _number(n(1, 15), rng), lambda: _number(n(20, 40), rng), lambda: f"{n(0, 2**62):x}{n(0, 2**62):x}",
        lambda: f"{n(1, 99)} at {n(1, 99)}", lambda: f"v{n(0, 9)}.{n(0, 99)}", lambda: f"978-{n(0, 10)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 10)}", lambda: f"({n(1, 99)}) {n(1, 999)}", lambda: f"@{n(1, 99)}", lambda: f"{n(1, 99)} - {n(100, 999)}", lambda: f"#{n(1, 10**6)}",
    )
    return forms[n(0, len(forms))]()


def training_windows(texts: list[str], most: int = MOST_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded classes, lengths and tags of windows: at most a third of spans as they are, as many respelled and without any."""
    rng = np.random.default_rng(seed)
    each: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

    def add(kind: int, parts: list[tuple[str, int]]) -> None:
        """A window that holds the first part with a tag (or the middle), at any place."""
        text, tags = "".join(t for t, _ in parts), np.concatenate([np.full(len(t), k, dtype=np.int8) for t, k in parts])
        marked = np.flatnonzero(tags)
        low, high = (int(marked[0]), int(marked[-1]) + 1) if len(marked) else (len(text) // 2, len(text) // 2 + 1)
        spare = max(1, FITTED - (high - low))
        a = max(0, low - int(rng.integers(0, spare + 1)))
        each[kind].append((char_classes(text[a : a + FITTED]), tags[a : a + FITTED]))

    known = [(text, shapes(text)) for text in texts]
    most_rounds = ROUNDS if any(s for _, s in known) else 1
    for text, spans in (x for _ in range(most_rounds) for x in known):
        if min(map(len, each)) >= most // len(each):
            break  # a small sample is gone through again, with other places and spellings
        for kind, a, b in (spans[i] for i in rng.permutation(len(spans))[:MOST_SPANS].tolist()):
            low, high = max(0, a - FITTED), min(len(text), b + FITTED)
            tags = np.zeros(high - low, dtype=np.int8)
            for k, x, y in spans:
                if x < high and y > low:
                    part = tags[max(0, x - low) : y - low]
                    part[part == 0] = k + 1
            add(0, list(zip(text[low:high], tags.tolist(), strict=True)))
            if not tags[: a - low].any() and not tags[b - low :].any():
                for _ in range(RESPELLED):
                    add(1, [(text[low:a], 0), *respelled(kind, text[a:b], rng), (text[b:high], 0)])
        free = int(rng.integers(0, max(1, len(text) - FITTED)))
        low, high = free, min(len(text), free + FITTED)
        if high > low and not any(x < high and y > low for _, x, y in spans):
            add(2, [(text[low:high], 0)])
            middle = low + int(rng.integers(0, high - low))
            add(2, [(text[low:middle], 0), (f" {decoy(rng)} ", 0), (text[middle:high], 0)])
    if not each[0]:
        return np.zeros((0, FITTED), np.uint8), np.zeros(0, np.int64), np.zeros((0, FITTED), np.int64)
    chosen = [part[i] for part in each for i in rng.permutation(len(part))[: most // len(each)].tolist()]
    x, y = np.zeros((len(chosen), FITTED), np.uint8), np.zeros((len(chosen), FITTED), np.int64)
    n = np.array([len(c) for c, _ in chosen], dtype=np.int64)
    for i, (c, t) in enumerate(chosen):
        x[i, : len(c)], y[i, : len(t)] = c, t
    return x, n, y


def train(texts: list[str], epochs: int = EPOCHS) -> BiLstmCrf | None:
    x, n, y = training_windows(texts)
    if not (y > 0).any():
        return None
    model = BiLstmCrf()
    model.fit(x, n, y, epochs)
    return model


def added_spans(model: BiLstmCrf | None, texts: list[str], base: list[list[tuple[int, int, int]]], block: int = BLOCK) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in each text that overlap no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    classes = [char_classes(t) for t in texts]
    windows = [windows_of(len(t)) for t in texts]
    spans = [(b - a, i, k, a, b) for i, w in enumerate(windows) for k, (a, b) in enumerate(w)]
    spans.sort()  # windows of one length together
    tags: dict[int, dict[int, np.ndarray]] = {}
    for k in range(0, len(spans), block):
        part = spans[k : k + block]
        n = np.array([x[0] for x in part], dtype=np.int64)
        x = np.zeros((len(part), int(n[-1])), dtype=np.uint8)
        for row, (length, i, _, a, b) in zip(x, part, strict=True):
            row[:length] = classes[i][a:b]
        found = model.decode(x, n)
        for r in np.flatnonzero(found.any(1)).tolist():
            length, i, at, _, _ = part[r]
            tags.setdefault(i, {})[at] = found[r, :length]
    for i, rows in tags.items():
        text = texts[i]
        t = reconciled(windows[i], [rows.get(k, np.zeros(b - a, np.int8)) for k, (a, b) in enumerate(windows[i])])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]]).tolist()
        taken = sorted((a, b) for _, a, b in base[i])
        until = list(itertools.accumulate((b for _, b in taken), max))
        for a, b in itertools.pairwise(edges):
            kind = int(t[a]) - 1
            if kind < 0:
                continue
            before = bisect_left(taken, (b, 0))  # base spans that begin before the end
            if (not before or until[before - 1] <= a) and plausible(kind, text[a:b]):
                out[i].append((kind, a, b))
    return out


def sample_texts(docs: DataFrame, most_docs: int = MOST_DOCS) -> list[str]:
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    rows = thinned(some, "doc_id", most_docs, some.count()).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most_docs).collect()
    return [r["text"] for r in rows]


def find_personal_data(docs: DataFrame, most_docs: int = MOST_DOCS, epochs: int = EPOCHS) -> DataFrame:
    """``doc_id, base, spans`` of each row: arrays of (kind, start, end), of the base spans and of all."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(train(sample_texts(docs, most_docs), epochs))
    kind = "array<struct<kind: string, start: int, end: int>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base)
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in found], shape) for found in (base, [x + y for x, y in zip(base, more, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")

