"""Template residue, filler and error pages, by character n-gram models and likelihood-ratio windows.

Runs of ``GRAM`` characters (lower case, digits alike, white space as one blank) are counted in tables of fixed size:
the natural model over all documents, the residue models over seed phrases and, in one more pass, over the documents
that the seeds already cover almost wholly. With the natural model as their Dirichlet prior, the residue models give
every run a log ratio; windows of ``WINDOW`` runs with a mean above ``CUT`` are residue. Open slots have a model of
their own, over the shapes of characters (capital, small letter, digit, or the sign itself); in its windows the exact
form of a slot is looked for. A document is excluded when the windows cover at least half of what is neither heading
nor navigation, or when it holds an open slot that is not merely spoken of.

The lines of many documents are laid out in one array, so that runs, ratios, running sums and windows are array
operations on a slab of text at a time. A line longer than a slab is cut into pieces that overlap by a window on either side, and
every character counts in one piece only: the cut changes nothing.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import residue_seeds as seeds

GRAM, WINDOW, BITS = 4, 16, 18
CUT, COVER, LEAST_SHARE, LEAST_CHARS = 0.6, 0.5, 0.15, 10
SLOT_WINDOW, SLOT_CUT = 4, 1.0
KINDS = ("filler", "error", "notice")
_SLOT, _SPOKEN = re.compile(seeds.SLOT), re.compile(seeds.SPOKEN_OF)
_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_BLANKS = re.compile(r"[^\S\n]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SLAB = 1 << 20
_EDGE = WINDOW + GRAM  # what a piece of a line shares with its neighbours
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


class _Classes:
    """Letters and digits, and the shapes of all characters, as tables by code point."""

    alnum = lower = shape = None

    @classmethod
    def load(cls) -> type[_Classes]:
        if cls.alnum is None:
            chars = [chr(i) for i in range(0x110000)]
            cls.alnum = np.fromiter((c.isalnum() for c in chars), bool, len(chars))
            lower = np.arange(0x110000, dtype=np.uint32)
            shape = lower.copy()
            for i, c in enumerate(chars[:0x20000]):
                if (x := c.lower()) != c and len(x) == 1:
                    lower[i] = ord(x)
                if c.isdigit():
                    lower[i] = shape[i] = 48
                elif c.isalpha():
                    shape[i] = 88 if c == "X" else 65 if c.isupper() else 97  # X often stands for something to fill in
                elif c.isspace():
                    lower[i] = shape[i] = 32
            cls.lower, cls.shape = lower, shape
        return cls


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Table place of the run that begins one character before each of ``c``; both ends are padded with blanks."""
    p = np.full(len(c) + GRAM - 1, 32, np.uint32)
    p[1 : len(c) + 1] = c
    h = p[: len(c)] * _MUL[0]
    for j in range(1, GRAM):
        h += (p[j : j + len(c)] + np.uint32(j)) * _MUL[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def counts_of(text: str, shapes: bool = False) -> np.ndarray:
    x = _Classes.load()
    c = codes(_BLANKS.sub(" ", text).strip())
    return np.bincount(grams((x.shape if shapes else x.lower)[c]), minlength=1 << BITS)


def seed_counts() -> np.ndarray:
    """Counts of the seed phrases by kind, sentence by sentence; the last row is that of the shapes of slots."""
    out = np.zeros((len(KINDS) + 1, 1 << BITS))
    for i, text in enumerate((seeds.FILLER, seeds.ERROR, seeds.NOTICE)):
        for line in text.strip().splitlines():
            for s in re.split(r"(?<=[.?!]) ", line):
                out[i] += counts_of(s)
    for line in seeds.SLOTS.strip().splitlines():
        for s in line.split("  "):
            for before, after in product(("", "a ", "("), ("", ",", ".", ":", "!", " a", ")")):  # what may stand around a slot
                out[-1] += counts_of(before + s + after, True)
    return out


def log_ratios(residue: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """Log ratio of each run, by kind, with the natural model (a row, or a row a kind) as prior of the residue models."""
    natural = np.atleast_2d(natural)
    p = (natural + 0.5) / (natural.sum(axis=1, keepdims=True) + 0.5 * natural.shape[1])
    n = residue.sum(axis=1, keepdims=True)
    weight = 0.25 * n + 1
    return np.log((residue + weight * p) / ((n + weight) * p)).clip(-2.0, 4.0).astype(np.float32)


class Slab:
    """The lines of some documents, without those that are blank, in one array.

    ``owner`` is the document of each line, ``begin`` and ``size`` its place in ``chars``; two blanks lie between lines.
    ``own`` marks the characters that this slab counts: of a piece of a long line not those that it shares.
    """

    def __init__(self, lines: list[tuple[int, str, int, int]]):
        x = _Classes.load()
        self.text = "\n\n".join(t for _, t, _, _ in lines)
        self.chars = codes(self.text)
        self.owner = np.array([d for d, *_ in lines], np.int64)
        self.size = np.fromiter((len(t) for _, t, _, _ in lines), np.int64, len(lines))
        self.begin = np.cumsum(self.size + 2) - self.size - 2
        self.line = np.repeat(np.arange(len(lines)), self.size + 2)[: len(self.chars)]
        at = np.arange(len(self.chars)) - self.begin[self.line]
        lo, hi = np.array([a for *_, a, _ in lines]), np.array([b for *_, b in lines])
        self.own = (at >= lo[self.line]) & (at < hi[self.line])
        self.inside = at < self.size[self.line]
        self.grams = grams(x.lower[self.chars])
        self.alnum = x.alnum[self.chars] & self.own

    def shapes(self) -> np.ndarray:
        return grams(_Classes.load().shape[self.chars])

    def covered(self, ratio: np.ndarray, window: int, cut: float) -> np.ndarray:
        """Characters inside windows whose mean ratio is above the cut; a line shorter than a window is one window."""
        r = np.where(self.inside, ratio, 0)
        total = np.concatenate(([0.0], np.cumsum(r, dtype=np.float64)))
        mark = np.zeros(len(r) + 1, np.int32)
        long = self.size >= window
        if len(r) >= window:
            ok = (total[window:] - total[:-window] > cut * window) & self.inside[window - 1 :]
            start = np.nonzero(ok)[0]
            start = start[self.line[start] == self.line[start + window - 1]]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + window, -1)
        b, e = self.begin[~long], (self.begin + self.size)[~long]
        hit = (total[e] - total[b] > cut * (e - b)) & (e - b >= 5)
        np.add.at(mark, b[hit], 1)
        np.add.at(mark, e[hit], -1)
        return np.cumsum(mark[:-1]) > 0


def slabs(texts: list[str | None], least: int = 1, size: int = _SLAB):
    """Slabs of the lines of the texts; a piece knows which of its characters are its own."""
    lines, room = [], 0
    for d, t in enumerate(texts):
        if not t:
            continue
        for s in t.split("\n"):
            s = _BLANKS.sub(" ", s).strip()
            if len(s) < least:
                continue
            if len(s) <= size:
                lines.append((d, s, 0, len(s)))
                room += len(s)
            else:
                for a in range(0, len(s), size):
                    lo, hi = max(0, a - _EDGE), min(len(s), a + size + _EDGE)
                    yield Slab([(d, s[lo:hi], a - lo, min(a + size, len(s)) - lo)])
            if room >= size:
                yield Slab(lines)
                lines, room = [], 0
    if lines:
        yield Slab(lines)


def _is_heading(s: str) -> bool:
    return s[-1] not in ".!?:;" and (len(s.split()) <= 8 or " | " in s)


def open_slots(text: str) -> int:
    """Slots in sentences that do not speak of slots, outside code."""
    if not _SLOT.search(text):
        return 0
    n = 0
    for s in _SENTENCE.split(_FENCE.sub(" ", text)):
        found = _SLOT.findall(s)
        if found and not _SPOKEN.search(_SLOT.sub(" ", s)):
            n += len(found)
    return n


def measure(texts: list[str | None], ratios: np.ndarray, size: int = _SLAB) -> dict[str, np.ndarray]:
    """Coverage by residue, residue characters, open slots and kind of each text; ratios by kind, the last one of slots."""
    n, k = len(texts), len(KINDS)
    total, body, hits, near = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((k, n), np.int64), np.zeros(n, bool)
    for x in slabs(texts, size=size):
        m = len(x.owner)
        alnum = np.bincount(x.line[x.alnum], minlength=m)
        of_line = np.zeros((k, m), np.int64)
        for j in range(k):
            at = x.covered(ratios[j][x.grams], WINDOW, CUT) & x.alnum
            of_line[j] = np.bincount(x.line[at], minlength=m)
        total += np.bincount(x.owner, alnum, n).astype(np.int64)
        for j in range(k):
            hits[j] += np.bincount(x.owner, of_line[j], n).astype(np.int64)
        best = of_line.max(axis=0)
        plain = alnum.copy()
        for i in np.nonzero(best < alnum)[0]:  # where a line is covered whole, it doesn't matter
            a = x.begin[i]
            if x.size[i] < 200 and _is_heading(x.text[a : a + x.size[i]]):
                plain[i] = 0
        body += np.bincount(x.owner, np.maximum(plain, best), n).astype(np.int64)
        slot = x.covered(ratios[-1][x.shapes()], SLOT_WINDOW, SLOT_CUT)
        near[x.owner[np.unique(x.line[slot])]] = True
    k = hits.argmax(axis=0)
    covered = hits[k, np.arange(n)] if n else np.zeros(0, np.int64)
    share = np.where(body > 0, np.minimum(1.0, covered / np.maximum(body, 1)), 0.0)
    share[(covered < LEAST_CHARS) | (covered < LEAST_SHARE * total)] = 0.0
    slots = np.fromiter((open_slots(t) if near[i] else 0 for i, t in enumerate(texts)), np.int64, n)
    return {"share": share, "covered": covered, "slots": slots, "kind": k, "near": near}


def _texts(batches, rows: int = 2048):
    for b in batches:
        for off in range(0, b.num_rows, rows):
            part = b.slice(off, rows)
            yield part, part.column(1).to_pylist()


def _partial(total: np.ndarray):
    kind, gram = np.nonzero(total)
    return pa.record_batch([pa.array(kind, pa.int64()), pa.array(gram, pa.int64()), pa.array(total[kind, gram])], names=["kind", "gram", "n"])


def _count_natural(batches):
    """Partial counts of the runs of characters and of shapes in all texts."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for _, texts in _texts(batches):
        for x in slabs(texts):
            own = x.own & x.inside
            total[0] += np.bincount(x.grams[own], minlength=1 << BITS)
            total[1] += np.bincount(x.shapes()[own], minlength=1 << BITS)
    yield _partial(total)


def _count_residue(batches, ratios: np.ndarray):
    """Partial counts by kind of the texts that the given ratios cover to at least 90 %."""
    total = np.zeros((len(KINDS), 1 << BITS), np.int64)
    for _, texts in _texts(batches):
        got = measure(texts, ratios)
        good = np.nonzero((got["share"] >= 0.9) & (got["slots"] == 0) & (got["covered"] >= 25))[0]
        for k in range(len(KINDS)):
            for x in slabs([texts[i] for i in good if got["kind"][i] == k]):
                total[k] += np.bincount(x.grams[x.own & x.inside], minlength=1 << BITS)
    yield _partial(total)


def _table(docs: DataFrame, kinds: int, count) -> np.ndarray:
    """Counts over all documents: at most ``kinds`` x 2**BITS numbers, whatever the input."""
    rows = docs.mapInArrow(count, "kind long, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((kinds, 1 << BITS))
    out[rows["kind"].to_numpy(np.int64), rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def fit(documents: DataFrame) -> np.ndarray:
    """Log ratios of the residue models and of the slot model, from the seeds and all documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    natural, residue = _table(docs, 2, _count_natural), seed_counts()
    for line in seeds.NATURAL.strip().splitlines():
        natural[0] += counts_of(line)
        natural[1] += counts_of(line, True)
    slots = log_ratios(residue[-1:], natural[1])
    first = np.concatenate([log_ratios(residue[:-1], natural[0]), slots])
    more = _table(docs, len(KINDS), lambda it: _count_residue(it, first))
    weight = np.minimum(1.0, residue[:-1].sum(axis=1) / np.maximum(more.sum(axis=1), 1))[:, None]  # as much as the seeds at most
    return np.concatenate([log_ratios(residue[:-1] + more * weight, natural[0]), slots])


def _score(batches, ratios: np.ndarray):
    for part, texts in _texts(batches):
        got = measure(texts, ratios)
        share, slots = got["share"], got["slots"]
        kind = ["slot" if n and s < COVER else KINDS[k] if s >= COVER else None for s, n, k in zip(share.tolist(), slots.tolist(), got["kind"].tolist())]
        flag = (share >= COVER) | (slots > 0)
        yield pa.record_batch([part.column(0), pa.array(share), pa.array(got["covered"]), pa.array(slots), pa.array(kind, pa.string()), pa.array(flag)], names=["doc_id", "coverage", "residue_chars", "open_slots", "kind", "excluded"])


def template_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, coverage, residue_chars, open_slots, kind, excluded): one row a row of ``documents``.

    Null and empty texts are not residue. Repeated rows and null ids are kept as they are; other columns are ignored.
    An empty input gives an empty result.
    """
    ratios = fit(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _score(it, ratios), "doc_id long, coverage double, residue_chars long, open_slots long, kind string, excluded boolean")
