"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(m * rate) edits. It is cut into k + 1 pieces: k edits leave at
least one piece whole, so every occurrence holds an exact piece. One Aho-Corasick automaton finds the pieces of all items
in a text; Myers' bit-parallel distance then verifies the window around each hit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep_rows

#: Edits allowed per character of an item, and the shortest item that may have any (after normalising).
RATE, MIN_CHARS = 0.08, 24
#: Characters of items handled by one automaton (a bound on what is broadcast; more items make more blocks).
BLOCK_CHARS = 2_000_000
SCHEMA = "doc_id long, item_id long, distance int, budget int, item_chars int"
_NOT_WORD = re.compile(r"[\W_]+")
#: Scripts that set no space between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    """Lower-cased words with one space between them."""
    return _NOT_WORD.sub(" ", text.lower()).strip()


def budget_of(item: str, rate: float = RATE, min_chars: int = MIN_CHARS) -> int:
    """Edits that an item may have; shorter ones than ``min_chars`` only count as they are."""
    return 0 if len(item) < min_chars else int(len(item) * rate)


def stands_alone(s: str, start: int, end: int) -> bool:
    """Whether no word of ``s`` goes on over either end of ``s[start:end]``."""
    return all(at in (0, len(s)) or " " in s[at - 1 : at + 1] or _UNSPACED.search(s[at - 1 : at + 1]) for at in (start, end))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): error budget plus one pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> int:
    """Least edit distance between ``item`` and any substring of ``text``, or ``most + 1`` if it is larger than ``most``."""
    m = len(item)
    if masks is None:
        masks = peq(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, left = full, 0, m, most + 1, len(text)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        left -= 1
        if score < best:
            best = score
            if not best:
                break
        elif score - left > most:  # each further character lowers the score by one at most
            break
    return best


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


class Matcher:
    """All items of one block. Sent to the workers as plain items; each worker builds its automaton once."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items, self.rate, self.min_chars, self.automaton = items, rate, min_chars, None

    def __getstate__(self):
        return {"items": self.items, "rate": self.rate, "min_chars": self.min_chars, "automaton": None}

    def _build(self) -> None:
        import ahocorasick

        self.budgets = [budget_of(item, self.rate, self.min_chars) for _, item in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for at, piece in pieces(item, self.budgets[k]):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()
        self.masks = [peq(item) for _, item in self.items]

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, budget, item length) of every item that occurs within its budget."""
        if not text or not self.items:
            return []
        if self.automaton is None:
            self._build()
        s = normalise(text)
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, owners) in self.automaton.iter(s):
            for k, at in owners:
                item = self.items[k][1]
                budget = self.budgets[k]
                if len(s) < len(item) - budget or best.get(k) == 0:
                    continue
                start = end - size + 1 - at
                if len(item) < self.min_chars and not stands_alone(s, start, end + 1):
                    continue
                if s.startswith(item, max(0, start)) and start >= 0:
                    best[k] = 0
                    continue
                # Windows are taken on a grid, so that the hits of one occurrence share a window.
                step = budget + 1
                cell = start // step
                if (k, cell) in tried:
                    continue
                tried.add((k, cell))
                window = s[max(0, cell * step - budget) : cell * step + step + len(item) + budget]
                d = myers(item, window, min(budget, best.get(k, budget + 1) - 1), self.masks[k])
                if d <= budget and d < best.get(k, budget + 1):
                    best[k] = d
        return [(self.items[k][0], d, self.budgets[k], len(self.items[k][1])) for k, d in sorted(best.items())]


def blocks(benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS):
    """Matchers over all usable items, in blocks of bounded size, one block on the driver at a time."""
    held: list[tuple[int | None, str]] = []
    size = 0
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        item = normalise(r["text"])
        if not item:
            continue
        held.append((r["item_id"], item))
        size += len(item)
        if size >= block_chars:
            yield Matcher(held, rate, min_chars)
            held, size = [], 0
    if held:
        yield Matcher(held, rate, min_chars)


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and item found in it: doc_id, item_id, least distance, budget and item length.

    Null and empty texts hold nothing; very long ones are read whole. Null and empty items (normalised) are not looked for,
    items under ``min_chars`` only as they are and as whole words. Items without an id have a null one; items or rows that
    repeat give rows each; an empty benchmark or table gives no rows; further columns, whatever their names, are not read.
    """
    source, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for matcher in blocks(benchmark, rate, min_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def search(cols, shared=shared):
            rows = [(doc_id, *m) for doc_id, text in zip(*cols) for m in shared.value.matches(text)]
            return [list(c) for c in zip(*rows)] if rows else None

        found = arrow_map(source, search, SCHEMA, most=256)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with their own columns, whatever their names.

    Null and empty texts stay, as do null ids and repeated rows; an empty table stays empty, an empty benchmark keeps all.
    """
    for matcher in blocks(benchmark, rate, min_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def is_clean(texts, shared=shared):
            return [not shared.value.matches(None if t is None else t.decode("utf-8", "replace")) for t in texts]

        docs = keep_rows(docs, ["text"], is_clean, most=256)
    return docs
