"""Chat formatting: roles of transcript turns by a hidden Markov model, then canonical rendering.

A row's text is cut into segments at lines that begin with a speaker marker (``Human:``, ``### Assistant``, ``[user]``,
``<|system|>``); a text without any is one segment.  Hidden states of the segments are the roles.  Observations are
the segment's own marker, the role column (of the row's first segment; markers of either kind are noisy, may be
missing and have many spellings) and features of its lines (length, number of lines, question mark at the end, list or
code lines).  Moves between rows and within a row have probabilities of their own.  All probabilities, those of markers
being wrong among them, are fitted by Baum-Welch steps from priors that tie each marker to its role, over a bounded
sample (``most_turns`` rows: whole conversations with the smallest hashes).  Viterbi then recovers the most likely
roles of each conversation.

A conversation may be of any length, and so may the rows of one turn number: rows are sorted by conversation and turn
in ranges of about equal size, whatever their keys, and cut into blocks.  A conversation that lies within a block is
decoded at once.  Of others, each block is summed up as a small matrix (the best score from each entering role to each
leaving role), the matrices are multiplied out in max-plus algebra, and each block then runs Viterbi between its pinned
ends.  The result is that of one Viterbi run.

Rendering: ``<|role|>`` on a line, the text, ``<|end|>``.  Neighbouring segments of a row with one role are one turn;
turns of different rows stay apart.  Outer white space goes, and so does a marker at the start of a turn that names the
turn's role, unless it is a word that texts use otherwise (``Answer:``, ``Context:``) and the role column is given:
nothing else is left out.  ``<|`` within texts is written ``<||``, so that no text can forge a turn; ``parse`` undoes it.

Defined results: null or empty text renders as an empty turn; null roles are recovered; turns are ordered by turn
(null first), then role, then a hash of the text, so that ties have one order and repeated rows stay; rows of null conv_id are
conversations of one row each; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import has_rows, prepare, runs, thinned, written

ROLES = ("system", "user", "assistant", "tool")
#: Spellings of speaker markers (fixed values): names of speakers, and words that texts also use otherwise.
SPEAKERS = {
    "system": "system", "sys": "system",
    "user": "user", "human": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "chatbot": "assistant",
    "tool": "tool", "ipython": "tool",
}
WORDS = {
    "instruction": "system", "instructions": "system", "context": "system",
    "you": "user", "question": "user", "q": "user", "customer": "user",
    "model": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant",
    "function": "tool", "observation": "tool",
}
MOST_TURNS = 20_000
BLOCK_TURNS, BLOCK_CHARACTERS = 2048, 1 << 24
STEPS = 6
#: Segments of a conversation that are fitted together.
FITTED = 128
LENGTHS = (40, 120, 300, 800, 2000)
_K = len(ROLES)
_MARK = re.compile(r"^[^\S\n]*(?:<\|(\w{1,16})\|>|\[(\w{1,16})\]|#{0,3}[^\S\n]*\*{0,2}(\w{1,16})\*{0,2}[^\S\n]*([:>]))[^\S\n]*\n?", re.M)
#: Values of each observation: own marker (speaker or word of each role, or none), role column, then the features.
_SIZES = (2 * _K + 1, _K + 1, len(LENGTHS) + 1, 3, 2, 2)


@dataclass
class Segment:
    start: int
    body: int  # where the text behind the marker starts
    end: int
    mark: int  # of _SIZES[0]
    column: int  # of _SIZES[1]
    inside: bool  # not the first of its row

    def observed(self, text: str) -> tuple[int, ...]:
        body = text[self.body : self.end].strip()
        structured = "```" in body or re.match(r"(?:[-*]|\d+[.)])\s", body) is not None
        return (self.mark, self.column, int(np.searchsorted(LENGTHS, len(body), side="right")), min(body.count("\n"), 2), int(body.endswith("?")), int(structured))


def segments(role: str | None, text: str | None) -> list[Segment]:
    """The segments of a row's text, which they cover without gaps."""
    text, given = text or "", (role or "").strip().lower()
    named = SPEAKERS.get(given) or WORDS.get(given)
    column = ROLES.index(named) if named else _K
    found = []
    for m in _MARK.finditer(text):
        name = next(g for g in m.groups() if g).lower()
        if name in SPEAKERS:
            found.append((m.start(), m.end(), ROLES.index(SPEAKERS[name])))
        elif name in WORDS and m[4] != ">":
            found.append((m.start(), m.end(), _K + ROLES.index(WORDS[name])))
    if not found or text[: found[0][0]].strip():
        found.insert(0, (0, 0, 2 * _K))
    ends = [*(f[0] for f in found[1:]), len(text)]
    return [Segment(a if i else 0, b, end, mark, column if not i else _K, i > 0) for i, ((a, b, mark), end) in enumerate(zip(found, ends, strict=True))]


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of rendered turns."""
    return [(role, body.replace("<||", "<|")) for role, body in re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", rendered, re.S)]


def rendered(text: str | None, parts: list[Segment], roles: list[int]) -> list[tuple[str, str]]:
    """(role, rendered turn) of a row: neighbouring segments of one role are one turn."""
    text, out, i = text or "", [], 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and roles[j] == roles[i]:
            j += 1
        first = parts[i]
        own = first.mark == roles[i] or first.mark == _K + roles[i] and parts[0].column == _K
        body = text[first.body if own else first.start : parts[j - 1].end].strip()
        out.append((ROLES[roles[i]], f"<|{ROLES[roles[i]]}|>\n{escape(body)}\n<|end|>\n"))
        i = j
    return out


def _priors() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pseudo-counts: markers name their roles, for want of other evidence."""
    one = np.eye(_K)
    mark = np.hstack([0.2 + 8 * one, 0.5 + 4 * one, np.full((_K, 1), 8.0)])
    column = np.hstack([0.2 + 12 * one, np.full((_K, 1), 4.0)])
    return np.full(_K, 0.5), np.stack([np.full((_K, _K), 0.5), 0.5 + one]), [mark, column, *(np.full((_K, n), 0.5) for n in _SIZES[2:])]


class RoleModel:
    """Log probabilities: of the first role, of moves between rows and within one, and of observations."""

    def __init__(self, start: np.ndarray, move: np.ndarray, seen: list[np.ndarray]):
        log = lambda t: np.log(t / t.sum(-1, keepdims=True))
        self.start, self.move, self.seen = log(start), log(move), [log(s) for s in seen]

    @classmethod
    def fit(cls, conversations: list[list[tuple[str | None, str | None]]], steps: int = STEPS) -> RoleModel:
        model = cls(*_priors())
        rows: list[tuple[bool, list[tuple[tuple[int, ...], bool]]]] = []
        for turns in conversations:
            seen = [(s.observed(text or ""), s.inside) for role, text in turns for s in segments(role, text)]
            rows += [(a == 0, seen[a : a + FITTED]) for a in range(0, len(seen), FITTED)]
        if not rows:
            return model
        width = max(len(r) for _, r in rows)
        obs, inside = np.zeros((len(rows), width, len(_SIZES)), np.int64), np.zeros((len(rows), width), np.int64)
        valid, first = np.zeros((len(rows), width), bool), np.array([f for f, _ in rows])
        for i, (_, r) in enumerate(rows):
            obs[i, : len(r)], inside[i, : len(r)], valid[i, : len(r)] = [o for o, _ in r], [k for _, k in r], True
        for _ in range(steps):
            model = model._step(obs, inside, valid, first)
        return model

    def _step(self, obs: np.ndarray, inside: np.ndarray, valid: np.ndarray, first: np.ndarray) -> RoleModel:
        """One Baum-Welch step: expected counts on top of the priors."""
        n, width = valid.shape
        likely = sum(s[:, obs[:, :, f]] for f, s in enumerate(self.seen)).transpose(1, 2, 0)
        likely = np.exp(likely - likely.max(2, keepdims=True))
        move = np.exp(self.move)
        ahead, scale = np.zeros((n, width, _K)), np.ones((n, width))
        now = np.where(first[:, None], np.exp(self.start), 1 / _K) * likely[:, 0]
        for t in range(width):
            if t:
                now = np.einsum("ni,nij->nj", ahead[:, t - 1], move[inside[:, t]]) * likely[:, t]
            scale[:, t] = now.sum(1)
            ahead[:, t] = now / scale[:, t, None]
        start, moves, seen = _priors()
        behind = np.ones((n, _K))
        for t in range(width - 1, -1, -1):
            here = ahead[:, t] * behind
            here = here / here.sum(1, keepdims=True) * valid[:, t, None]
            for f, table in enumerate(seen):
                np.add.at(table.T, obs[:, t, f], here)
            if not t:
                start = start + here[first].sum(0)
                break
            onward = likely[:, t] * behind / scale[:, t, None]
            pair = ahead[:, t - 1, :, None] * move[inside[:, t]] * onward[:, None, :] * valid[:, t, None, None]
            np.add.at(moves, inside[:, t], pair)
            behind = np.where(valid[:, t, None], np.einsum("nij,nj->ni", move[inside[:, t]], onward), 1.0)
        return RoleModel(start, moves, seen)

    def scores(self, observed: list[tuple[int, ...]]) -> np.ndarray:
        """Log probabilities of the observations (segments x roles)."""
        obs = np.array(observed, dtype=np.int64).reshape(-1, len(_SIZES))
        return sum(self.seen[f][:, obs[:, f]].T for f in range(len(_SIZES)))

    def transfer(self, scores: np.ndarray, inside: list[bool], first: bool) -> np.ndarray:
        """Best score of a block from each role before it to each role at its end."""
        best = np.broadcast_to(self.start, (_K, _K)) + scores[0] if first else self.move[0] + scores[0]
        for e, k in zip(scores[1:], inside[1:], strict=True):
            best = (best[:, :, None] + self.move[int(k)][None]).max(1) + e
        return best

    def path(self, scores: np.ndarray, inside: list[bool], first: bool, before: int, last: int) -> np.ndarray:
        """Roles of a block between the role before it and the role at its end (-1: whichever is best)."""
        best = (self.start if first else self.move[0][before]) + scores[0]
        back = np.zeros(scores.shape, dtype=np.int64)
        for t in range(1, len(scores)):
            to = best[:, None] + self.move[int(inside[t])]
            back[t] = to.argmax(0)
            best = to.max(0) + scores[t]
        out = np.zeros(len(scores), dtype=np.int64)
        out[-1] = best.argmax() if last < 0 else last
        for t in range(len(scores) - 1, 0, -1):
            out[t - 1] = back[t][out[t]]
        return out


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, rows: list[dict], model: RoleModel):
        self.rows, self.model = rows, model
        self.parts = [segments(r["role"], r["text"]) for r in rows]
        self.scores = model.scores([s.observed(r["text"] or "") for r, parts in zip(rows, self.parts, strict=True) for s in parts])
        self.inside = [s.inside for parts in self.parts for s in parts]

    def decoded(self, first: bool, before: int = 0, last: int = -1) -> list[list[tuple[str, str]]]:
        roles, at, out = self.model.path(self.scores, self.inside, first, before, last).tolist(), 0, []
        for r, parts in zip(self.rows, self.parts, strict=True):
            out.append(rendered(r["text"], parts, roles[at : at + len(parts)]))
            at += len(parts)
        return out

    def matrices(self) -> bytes:
        """As a conversation's first block, and as a later one."""
        return np.stack([self.model.transfer(self.scores, self.inside, first) for first in (True, False)]).tobytes()


def _turns(turns: DataFrame) -> DataFrame:
    """Turns with ``conv``, a key that is never null, and ``uid``, which tells repeated rows apart."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("null:"), F.col("uid").cast("string")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("uid"))
    return rows.withColumn("conv", conv)


def _sample(turns: DataFrame, most: int) -> list[list[tuple[str | None, str | None]]]:
    """Whole conversations by the hash of their key, up to about ``most`` turns (a longer one is cut)."""
    sizes = turns.groupBy("conv").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    first = thinned(sizes, "conv", most, sizes.count()).orderBy(F.xxhash64("conv"), "conv").limit(most)
    chosen = first.withColumn("sum", F.sum("n").over(Window.orderBy(F.xxhash64("conv"), "conv"))).where(F.col("sum") - F.col("n") < most)
    rows = turns.join(F.broadcast(chosen.select("conv")), "conv").orderBy(F.xxhash64("conv"), "conv", F.asc_nulls_first("turn"), "role", "tie").limit(2 * most)
    out: dict[str, list] = {}
    for r in rows.collect():
        out.setdefault(r["conv"], []).append((r["role"], r["text"]))
    return list(out.values())


_OUT = "conv_id long, turn long, part int, role string, role_recovered string, rendered string"
_OUT_ROWS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("role_recovered", pa.string()), ("rendered", pa.string())])
_PENDING = "conv string, block long, place int, text string, matrices binary"
_PENDING_ROWS = [pa.field("conv", pa.string()), pa.field("block", pa.int64()), pa.field("place", pa.int32()), pa.field("text", pa.string()), pa.field("matrices", pa.binary())]


def _finished(rows: list[dict], turns: list[list[tuple[str, str]]]) -> list[dict]:
    return [{"conv_id": r["conv_id"], "turn": r["turn"], "part": part, "role": r["role"], "role_recovered": role, "rendered": text} for r, own in zip(rows, turns, strict=True) for part, (role, text) in enumerate(own)]


def format_chats(turns: DataFrame, most_turns: int = MOST_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, turn, part, role, role_recovered, rendered``: the turns of each row of ``turns`` (conv_id, turn, role, text).

    ``part`` numbers, from 0, the turns that were found in one row.
    """
    spark = turns.sparkSession
    prepare(spark)
    keyed, _ = written(_turns(turns), "turns")  # uid must not change when a task is run again
    sent = spark.sparkContext.broadcast(RoleModel.fit(_sample(keyed, most_turns)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns of the conversations that lie within this partition and one block; the rows of others, with their blocks' matrices."""
        model, held, number = sent.value, [], TaskContext.get().partitionId() << 32
        schema = pa.schema([*_OUT_ROWS, *_PENDING_ROWS])
        whole, size = False, 0  # whether the held rows begin with their conversation; characters of them

        def flush(ended: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            block = _Block(held, model)
            if whole and ended:
                return pa.RecordBatch.from_pylist(_finished(held, block.decoded(True)), schema)
            rows = [{"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"], "conv": r["conv"], "block": number, "place": i, "text": r["text"]} for i, r in enumerate(held)]
            rows[0]["matrices"] = block.matrices()
            return pa.RecordBatch.from_pylist(rows, schema)

        for row in (r for batch in batches for r in batch.to_pylist()):
            if held and (len(held) >= block_turns or size >= BLOCK_CHARACTERS or held[0]["conv"] != row["conv"]):
                same = held[0]["conv"] == row["conv"]
                yield flush(not same)
                held, whole, size = [], not same, 0
            held.append(row)
            size += len(row["text"] or "")
        if held:
            yield flush(False)  # it may go on in the next partition

    def pin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The role before each block and at its end, on the best path of the conversation."""
        for group in runs(batches, ["conv"]):
            m = [np.frombuffer(x).reshape(2, _K, _K) for x in group.column("matrices").to_pylist()]
            best, back = m[0][0][0], []  # the first block starts from the start probabilities, whatever is before
            for x in m[1:]:
                to = best[:, None] + x[1]
                back.append(to.argmax(0))
                best = to.max(0)
            ends = [int(best.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.RecordBatch.from_arrays([group.column("conv").combine_chunks(), group.column("block").combine_chunks(), pa.array([-1, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], names=["conv", "block", "before", "last"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["conv", "block"]):
            rows = group.to_pylist()
            before, last = rows[0]["before"], rows[0]["last"]
            yield pa.RecordBatch.from_pylist(_finished(rows, _Block(rows, sent.value).decoded(before < 0, max(before, 0), last)), _OUT_ROWS)

    order = ["conv", F.asc_nulls_first("turn"), "role", "tie", "uid"]
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    found, _ = written(sorted_rows.mapInArrow(decode, f"{_OUT}, {_PENDING}"), "decoded")
    done = found.where("conv is null").select(*_OUT_ROWS.names)
    pending = found.where("conv is not null")
    if not has_rows(pending):
        return done
    pins = pending.where("matrices is not null").select("conv", "block", "matrices").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(pin, "conv string, block long, before int, last int")
    pins, _ = written(pins, "pins")
    rows = pending.select("conv", "block", "place", "conv_id", "turn", "role", "text").join(pins, ["conv", "block"])
    return done.unionByName(rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "place").mapInArrow(finish, _OUT))
