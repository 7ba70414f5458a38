"""Quality rules: base counts and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_weights, extend, labelled_sample, mix64, platt, word_hashes

#: Buckets of either half of the feature space: word uni- and bigrams, then byte 3- and 5-grams.
HALF = 1 << 15
#: Labelled documents of each class that the fit may read (the documented bound).
PER_CLASS = 1000
#: Kept if the calibrated probability of good quality is at least this.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text (all 0 for null or empty)."""
    if not text:
        return 0, 0, 0, 0, 0
    b = np.frombuffer(text, np.uint8)
    words = text.split()
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~_SPACE[b]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated, n3 = 0, len(words) - 2
    if n3 > 1:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n3:
            seen = Counter(windows)
            hit = np.fromiter((seen[w] > 1 for w in windows), bool, n3)
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + n3] |= hit
            repeated = int(covered.sum())
    return len(words), chars, int(np.count_nonzero(_SYMBOL[b])), len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): the square roots of the n-gram shares of each half, for the buckets that a text has."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at, values = [], []

    def add(grams: np.ndarray, first: int) -> None:
        n = np.bincount(grams)
        own = np.flatnonzero(n)
        at.append(own + first)
        values.append(np.sqrt(n[own] / len(grams)).astype(np.float32))

    w = word_hashes(text.lower())
    if len(w):
        pairs = mix64(w[:-1] * np.uint64(0xA24BAED4963EE407) + w[1:])
        add((np.concatenate([w, pairs]) & np.uint64(HALF - 1)).astype(np.int64), 0)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        three = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
        grams = [three * np.uint32(2654435761) >> np.uint32(17)]
        if len(b) >= 5:
            five = (three[:-2] * np.uint32(65599) + b[3:-1]) * np.uint32(65599) + b[4:]
            grams.append(five * np.uint32(2246822519) >> np.uint32(17))
        add(np.concatenate(grams), HALF)
    return (np.concatenate(at), np.concatenate(values)) if at else (np.zeros(0, np.int64), np.zeros(0, np.float32))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, text: bytes | None) -> float:
        at, values = features(text)
        z = float(values @ self.weights[at]) + self.offset
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def constant(share: float = 0.5) -> QualityModel:
    """A model that gives every text the same probability."""
    return QualityModel(np.zeros(2 * HALF, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 120, decay: float = 1e-5) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class; every fifth one only calibrates.

    Executors send back sparse feature vectors, not texts, and nothing for texts without an n-gram. Without labels, or with
    usable labels of one class alone, the model is constant.
    """
    rows, totals = labelled_sample(docs, labels, "quality", per_class, learnable_only=False)

    def sparse(texts):
        where, what = [], []
        for t in texts:
            at, values = features(t)
            where.append(at.astype("<i4").tobytes())
            what.append(values.astype("<f4").tobytes())
        return [where, what]

    found = extend(rows, ["text"], sparse, "at binary, v binary", keep=["doc_id", "label"]).collect()
    got = sorted(((r["doc_id"], r["label"], r["at"], r["v"]) for r in found if r["at"]), key=lambda r: (r[0], r[1]))
    y = np.array([r[1] for r in got], np.float64)
    if len(np.unique(y)) < 2:
        return constant(float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5)
    lengths = np.array([len(r[2]) // 4 for r in got])
    at = np.concatenate([np.frombuffer(r[2], "<i4") for r in got]).astype(np.int64)
    v = np.concatenate([np.frombuffer(r[3], "<f4") for r in got]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(y)), lengths)
    calibrates = np.arange(len(y)) % 5 == 4
    learns = (~calibrates).astype(np.float64)
    balance = np.where(y == 1, 0.5 / max(1.0, (learns * (y == 1)).sum()), 0.5 / max(1.0, (learns * (y == 0)).sum())) * learns
    w, c = np.zeros(2 * HALF), 0.0
    m, s, mc, sc = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam over the whole sample
        z = np.add.reduceat(v * w[at], first) + c
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.bincount(at, weights=v * r[owner], minlength=2 * HALF) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mc, sc = 0.9 * mc + 0.1 * r.sum(), 0.999 * sc + 0.001 * r.sum() ** 2
        rate = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(s) + 1e-8)
        c -= rate * mc / (np.sqrt(sc) + 1e-8)
    z = np.add.reduceat(v * w[at], first) + c
    own = calibrates if len(np.unique(y[calibrates])) == 2 else np.ones(len(y), bool)
    slope, shift = platt(z[own], y[own], class_weights(y[own], totals))
    return QualityModel(w.astype(np.float32), float(c), slope, shift)


def apply(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """Add the base counts, ``base_failed``, ``probability`` and ``kept`` to ``docs``.

    Null and empty texts have no words, so they fail the base rules; very long texts are read whole. Rows are judged one by
    one: null ids, ties, repeated rows and further columns pass through; columns with the names of new ones are replaced; an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * HALF floats, whatever the corpus

    def judge(texts):
        counts = [base_counts(t) for t in texts]
        failed = [base_failed(c[0], c[4]) for c in counts]
        p = [shared.value.probability(t) for t in texts]
        return [*(list(c) for c in zip(*counts)), failed, p, [not f and x >= keep_at for f, x in zip(failed, p)]]

    columns = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, probability double, kept boolean"
    return extend(docs, ["text"], judge, columns, keep=keep, most=256)
