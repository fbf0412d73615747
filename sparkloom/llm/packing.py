"""Packing of tokenised documents into sequences by bin completion.

1. ``tokenise`` cuts each document's ids (with id 0 at the end) into pieces of at most ``capacity``.
2. The pieces' lengths are counted.  There are at most ``capacity`` different lengths, so this histogram, and all
   that the driver does with it, has a fixed size at any number of documents.
3. ``complete_bins`` solves the packing on the histogram.  Best fit decreasing, computed for groups of equal
   sequences, is the first incumbent; the second takes for the largest length left the filling that wastes least,
   as often as the counts allow, and so on.  If neither meets the lower bounds, ``_search`` branches over the
   fillings around the largest length left, sequence by sequence, and takes back earlier ones: fillings that
   another one dominates (Martello and Toth) are left out, and so are branches that cannot need fewer sequences
   than the incumbent: a branch may waste no more than an incumbent of one sequence less would.  The search visits at
   most ``budget`` nodes; if it ends before that, the packing is optimal, otherwise it is the best one found (no
   polynomial way is known to an optimum).  On large corpora lengths are so many that an incumbent meets the bound,
   which proves it optimal, and there is nothing to search.  Each branch uses a filling first as often as the counts allow, then once,
   so the number of steps depends on the number of lengths, not of documents.
4. Each piece takes a slot of its length: its rank among pieces of equal length, counted in salted parts so that
   a length that a third of all pieces share is not ranked in one task.

Defined results: null text counts as empty (one token, id 0); very long texts are cut into pieces; pieces of equal
length are taken in the order of doc_id and piece; an empty table gives no rows; rows that repeat a
doc_id are packed like any others; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SALTS, prepare, written

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts of other characters, or with a special token's mark, go through the tokenizer as a whole.
_PLAIN = re.compile(r"[^\t\n\r -~ -įĲ-ɏ]|<\|")
#: Words of the tokenizer's pre-tokenizer (its fixed pattern).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Token ids of texts, with a bounded memory of chunks (between white space) and of words seen.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` for tokenizers that lower the case, split by
    ``_WORDS`` and encode the bytes of each word alone; texts outside Latin letters take the tokenizer's own way.
    """

    def __init__(self, path: str, most: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are stored as little-endian 32-bit numbers")
        self.tokenizer, self.words, self.most = Tokenizer.from_file(path), regex.compile(_WORDS), most
        self.model = self.tokenizer.model
        # words and chunks met lately, and before: what is met again moves on, the rest is forgotten
        self.words_now: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.chunks_now: dict[str, bytes] = {}
        self.chunks_before: dict[str, bytes] = {}
        # byte-level spelling: printable bytes stand for themselves, the others for code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = (x for x in range(256) if x not in plain)
        self.spelling = {x: chr(256 + i) for i, x in enumerate(other)}

    def _word(self, word: str) -> bytes:
        ids = self.words_now.get(word)
        if ids is None:
            if 4 * len(self.words_now) >= self.most:
                self.words_before, self.words_now = self.words_now, {}
            ids = self.words_before.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
                ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            self.words_now[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        chunks = text.lower().split()
        new = set(chunks).difference(self.chunks_now)
        if new:
            if 2 * (len(self.chunks_now) + len(new)) > self.most:
                self.chunks_before, self.chunks_now = self.chunks_now, {}
                new = set(chunks)
            known, before = self.chunks_now, self.chunks_before
            for c in new:
                ids = before.get(c)
                if ids is None:
                    ids = self._word(c) if c.isalpha() else b"".join([self._word(w) for w in self.words.findall(c)])
                known[c] = ids
        return b"".join(map(self.chunks_now.__getitem__, chunks))


@lru_cache(2)
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + bytes(4)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, value in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(value)
            cols = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, dtype=np.int32) for x in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class Pattern:
    """``times`` sequences that each hold ``lengths`` (with their number, larger ones first)."""

    __slots__ = ("lengths", "times")

    def __init__(self, lengths: list[tuple[int, int]], times: int):
        self.lengths, self.times = lengths, times


def _best_fill(room: int, sizes: list[int], counts: dict[int, int], most_nodes: int) -> list[int]:
    """Lengths from ``sizes`` (ascending, with ``counts``) that leave least of ``room``: branch and bound.

    Depth first, larger lengths first, so the first leaf takes the largest lengths that fit and is the first
    incumbent; with ``most_nodes`` 0 it is also the answer (first fit decreasing).  A filling is dominated by one that has a larger length in a smaller
    one's place; going down from the largest that fits visits undominated ones first.  A branch is cut when all
    lengths it may still use, taken together, would leave no less than the incumbent does.
    """
    if not sizes or room < sizes[0]:
        return []
    below = [0]  # sum of the lengths up to each size
    for s in sizes:
        below.append(below[-1] + s * counts[s])
    best, best_left, nodes = [], room, 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes) - 1, ())]
    while stack and best_left:
        left, top, chosen = stack.pop()
        nodes += 1
        if left < best_left:
            best, best_left = list(chosen), left
        at = min(top, bisect_right(sizes, left) - 1)
        if at < 0 or left - below[at + 1] >= best_left:
            if nodes > most_nodes:
                break
            continue
        size = sizes[at]
        if at > 0:
            stack.append((left, at - 1, chosen))  # without this length: later
        if chosen.count(size) < counts[size]:
            stack.append((left - size, at, (*chosen, size)))
    return best


def _first_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the larger of total length and pieces over half of the capacity."""
    return max(-(-sum(k * n for k, n in hist.items()) // capacity), sum(n for k, n in hist.items() if 2 * k > capacity))


def _second_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: pieces over half of the capacity lie apart, and those from a length on fill what these leave."""
    sizes = sorted(k for k, n in hist.items() if n)
    best = 0
    for least in [0, *(k for k in sizes if 2 * k <= capacity)]:
        alone = sum(hist[k] for k in sizes if k > capacity - least)
        large = [(k, hist[k]) for k in sizes if 2 * k > capacity and k <= capacity - least]
        rest = sum(k * hist[k] for k in sizes if least <= k and 2 * k <= capacity)
        spare = sum((capacity - k) * n for k, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(rest - spare) // capacity)))
    return best


def _grouped(items: list[int]) -> list[tuple[int, int]]:
    return [(k, items.count(k)) for k in sorted(set(items), reverse=True)]


def _solve(hist: dict[int, int], capacity: int, most_nodes: int) -> list[Pattern]:
    counts = {k: n for k, n in hist.items() if n}
    out = []
    while counts:
        sizes = sorted(counts)
        top = sizes[-1]
        counts[top] -= 1
        usable = [s for s in sizes if counts[s]]
        fill = [top, *_best_fill(capacity - top, usable[: bisect_right(usable, capacity - top)], counts, most_nodes)]
        counts[top] += 1
        lengths = _grouped(fill)
        times = min(counts[k] // n for k, n in lengths)
        for k, n in lengths:
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append(Pattern(lengths, times))
    return out


def _best_fit_decreasing(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest first, each piece into the fullest sequence it fits in; equal sequences are filled together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left: contents and number of sequences
    rooms: list[int] = []  # ascending
    for size in sorted((k for k, n in hist.items() if n), reverse=True):
        left = hist[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                held, there = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, held, there = capacity, (), -(-left // (capacity // size))
            each = min(room // size, left)
            full = min(there, left // each)
            for part, times in ((each, full), (left - full * each if full < there else 0, min(1, there - full)), (0, there - full - 1)):
                if times > 0 and (part or held):
                    rest = room - part * size
                    if rest not in groups:
                        groups[rest] = []
                        insort(rooms, rest)
                    groups[rest].append((held + (size,) * part, times))
                    left -= part * times
    return [Pattern(_grouped(list(held)), times) for room in rooms for held, times in groups[room]]


def _dominated(fill: tuple[int, ...], left: int, counts: dict[int, int], sizes: list[int]) -> bool:
    """Whether an unused length fits in place of none, of one smaller length or of two that it is no smaller than."""
    used = Counter(fill)
    kinds = sorted(used)
    pairs = [a + b for i, a in enumerate(kinds) for b in kinds[i:] if a != b or used[a] > 1]
    for gone, least in [(0, 1), *((a, a + 1) for a in kinds), *((p, p) for p in pairs)]:
        for x in sizes[bisect_left(sizes, least) : bisect_right(sizes, gone + left)]:
            if counts[x] > used[x]:
                return True
    return False


def _fillings(room: int, counts: dict[int, int], waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` that leave ``waste`` at most, larger lengths first."""
    sizes = sorted(k for k, n in counts.items() if n and k <= room)
    now = {k: counts[k] for k in sizes}  # the counts change while a caller searches on
    below = [0]
    for s in sizes:
        below.append(below[-1] + s * now[s])
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes) - 1, ())]
    while stack and budget[0] > 0:
        left, top, chosen = stack.pop()
        budget[0] -= 1
        at = min(top, bisect_right(sizes, left) - 1)
        if at < 0:
            if left <= waste and not _dominated(chosen, left, now, sizes):
                yield chosen
        elif left - below[at + 1] <= waste:
            size = sizes[at]
            stack.append((left, at - 1, chosen))
            if chosen.count(size) < now[size]:
                stack.append((left - size, at, (*chosen, size)))


def _search(hist: dict[int, int], capacity: int, most: int, left: list[int]) -> list[Pattern] | None:
    """A packing into fewer than ``most`` sequences, found by branching over the fillings of all sequences, or None.

    ``left`` holds the number of nodes that may still be visited.
    """
    counts = {k: n for k, n in hist.items() if n}
    slack = (most - 1) * capacity - sum(k * n for k, n in counts.items())
    path: list[tuple[Counter, int, int]] = []  # filling, times, waste

    def use(lengths: Counter, times: int) -> None:
        for k, n in lengths.items():
            counts[k] -= n * times

    def choices(waste: int) -> Iterator[tuple[Counter, int, int]]:
        top = max(k for k, n in counts.items() if n)
        counts[top] -= 1
        found = _fillings(capacity - top, counts, min(waste, capacity), left)
        first = next(found, None)
        counts[top] += 1
        while first is not None:
            lengths = Counter((top, *first))
            each = capacity - sum(k * n for k, n in lengths.items())
            times = min(counts[k] // n for k, n in lengths.items())
            times = min(times, waste // each) if each else times
            for t in dict.fromkeys((times, 1)):
                yield lengths, t, each * t
            first = next(found, None)

    levels = [choices(slack)] if slack >= 0 and counts else []
    while levels and left[0] > 0:
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            if path:
                lengths, times, waste = path.pop()
                use(lengths, -times)
                slack += waste
            continue
        use(step[0], step[1])
        slack -= step[2]
        path.append(step)
        if not any(counts.values()):
            return [Pattern(_grouped(list(lengths.elements())), times) for lengths, times, _ in path]
        levels.append(choices(slack))
    return None


def complete_bins(hist: dict[int, int], capacity: int = CAPACITY, most_nodes: int = 2000, budget: int = 100_000) -> list[Pattern]:
    """Patterns that use up the histogram {length: pieces}; ``most_nodes`` bounds one filling, ``budget`` the search.

    Best fit decreasing is the incumbent; the lower bound ends the search.
    """
    size = lambda patterns: sum(p.times for p in patterns)
    least = max(_first_bound(hist, capacity), _second_bound(hist, capacity))
    best = _best_fit_decreasing(hist, capacity)
    if size(best) > least:
        best = min(best, _solve(hist, capacity, most_nodes), key=size)
    left = [budget]
    while size(best) > least and (better := _search(hist, capacity, size(best), left)):
        best = better
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` (of ``tokenise``, written down: it is read twice) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    dealt = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # at most capacity x salts numbers, whatever the number of pieces
    parts = dealt.groupBy("length", "__salt").count().toPandas()
    counts = np.zeros((capacity + 1, salts), dtype=np.int64)
    counts[parts["length"].to_numpy(), parts["__salt"].to_numpy()] = parts["count"].to_numpy()
    before = np.cumsum(counts, axis=1) - counts  # pieces of a length in the salts before
    hist = {int(k): int(counts[k].sum()) for k in np.flatnonzero(counts.sum(1))}
    slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in hist}  # first rank, first sequence, per sequence, offset
    taken, base = dict.fromkeys(hist, 0), 0
    for p in complete_bins(hist, capacity):
        at = 0
        for length, n in p.lengths:
            slots[length].append((taken[length], base, n, at))
            taken[length] += n * p.times
            at += n * length
        base += p.times
    tables = {k: np.array(v, dtype=np.int64).reshape(-1, 4) for k, v in slots.items()}
    names, schema = [*pieces.columns, "sequence_id", "offset"], pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            salt = batch.column(batch.schema.get_field_index("__salt")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy().astype(np.int64)
            seq, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for k in np.unique(length).tolist():
                mine = np.flatnonzero(length == k)
                r = rank[mine] + before[k, salt[mine]]
                t = tables[k]
                s = t[np.searchsorted(t[:, 0], r, side="right") - 1]
                seq[mine] = s[:, 1] + (r - s[:, 0]) // s[:, 2]
                offset[mine] = s[:, 3] + (r - s[:, 0]) % s[:, 2] * k
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset)], names=names)

    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1)
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs ``docs``."""
    pieces, _ = written(tokenise(docs, tokenizer_path, capacity=capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)
