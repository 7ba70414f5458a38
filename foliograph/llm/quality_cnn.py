"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Every byte becomes a short learned vector plus one
channel that says whether it continues a repetition; learned filters run over the chunk, each filter's largest response
is kept, and the chunks' responses are averaged and maximised into one vector for a logistic output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_weights, extend, held_out, keep_rows, labelled_sample, platt

CHUNK, OVERLAP = 1024, 32
WIDTH, STRIDE, CHANNELS, FILTERS = 8, 4, 8, 16
#: Labelled documents of each class, and bytes of their texts, that the fit may read (the documented bound). Texts are
#: taken whole, in the order of the sample, as long as they fit in what is left.
PER_CLASS, CLASS_BYTES = 800, 6_000_000
ACCEPT_AT = 0.7
#: Lags looked at for repetition, and the run of equal bytes that counts as one.
LAGS, RUN = range(2, 22), 8


def repetition(b: np.ndarray) -> np.ndarray:
    """1 where a byte ends a run of ``RUN`` bytes equal to those some lag earlier, else 0."""
    out = np.zeros(len(b), bool)
    for lag in LAGS:
        if len(b) < lag + RUN:
            break
        same = b[lag:] == b[:-lag]
        for k in (1, 2, 4):
            same = same[k:] & same[:-k]
        out[lag + RUN - 1 :] |= same
    return out


def chunks(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (0 beyond the end) and repetition of the chunks that cover a text; an empty text has one empty chunk."""
    b = np.frombuffer(text or b"", np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(b) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(b)] = b
    rep = np.zeros(len(padded), bool)
    rep[: len(b)] = repetition(b)
    rows = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step], np.lib.stride_tricks.sliding_window_view(rep, CHUNK)[::step]
    return rows[0], rows[1]


@dataclass
class Network:
    table: np.ndarray  # (256, CHANNELS): the last channel is 0 here and holds repetition
    filters: np.ndarray  # (WIDTH * CHANNELS, FILTERS)
    bias: np.ndarray
    head: np.ndarray  # (2 * FILTERS,)
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def start(seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.5, (256, CHANNELS)).astype(np.float32)
        table[:, -1] = 0
        return Network(table, r.normal(0, 0.15, (WIDTH * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32))

    def embed(self, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
        x = self.table[b]
        x[..., -1] = rep
        return x

    def responses(self, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """Filter responses (chunks, positions, FILTERS). Windows step by half their width, so each response is the sum
        of two products over whole blocks and no window is copied."""
        x = self.embed(b, rep).reshape(len(b), CHUNK // STRIDE, STRIDE * CHANNELS)
        half = STRIDE * CHANNELS
        out = x[:, :-1] @ self.filters[:half]
        out += x[:, 1:] @ self.filters[half:]
        return out

    def pooled(self, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
        parts = [self.responses(b[k : k + 64], rep[k : k + 64]).max(1) for k in range(0, len(b), 64)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def logit(self, text: bytes | None) -> float:
        h = self.pooled(*chunks(text))
        return float(np.concatenate([h.mean(0), h.max(0)]) @ self.head + self.offset)

    def probability(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(text) + self.shift, -30, 30))))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, s = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        s += 0.001 * (grad * grad - s)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def train(
    texts: list[bytes], y: np.ndarray, totals: dict[int, int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7
) -> Network:
    """Fit by Adam on four fifths of the documents and calibrate on the rest; one class alone gives a constant."""
    net = Network.start(seed)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        net.head[:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    r = np.random.default_rng(seed)
    data = [chunks(t) for t in texts]
    calibrates = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[calibrates])) < 2:
        calibrates[:] = False
    learns = np.flatnonzero(~calibrates)
    balance = np.where(y == 1, 0.5 / max(1, (y[learns] == 1).sum()), 0.5 / max(1, (y[learns] == 0).sum())) * len(learns)
    adam, offset = _Adam(rate), np.zeros(1, np.float32)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(learns), batch):
            if at == 0:
                r.shuffle(learns)
            own = learns[at : at + batch]
            b = np.concatenate([data[k][0] for k in own])
            rep = np.concatenate([data[k][1] for k in own])
            counts = np.array([len(data[k][0]) for k in own])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            doc = np.repeat(np.arange(len(own)), counts)
            z = net.responses(b, rep)
            top = z.argmax(1)  # (chunks, FILTERS)
            raw = np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias
            h = np.maximum(raw, 0)
            mean, most = np.add.reduceat(h, first) / counts[:, None], np.maximum.reduceat(h, first)
            logit = np.concatenate([mean, most], 1) @ net.head + offset[0]
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[own]) * balance[own] / len(own)).astype(np.float32)
            d_head = np.concatenate([mean, most], 1).T @ d + 1e-4 * net.head
            d_mean, d_most = d[:, None] * net.head[:FILTERS], d[:, None] * net.head[FILTERS:]
            dh = (d_mean / counts[:, None])[doc] + np.where(h == most[doc], d_most[doc], 0)
            dh = np.where(raw > 0, dh, 0).astype(np.float32)
            c, f = np.nonzero(dh)
            places = top[c, f][:, None] * STRIDE + np.arange(WIDTH)
            bytes_at = b[c[:, None], places]
            windows = net.embed(bytes_at, rep[c[:, None], places]).reshape(len(c), -1)
            g = dh[c, f][:, None]
            d_filters = np.zeros_like(net.filters)
            np.add.at(d_filters.T, f, windows * g)
            d_window = (net.filters.T[f] * g).reshape(len(c), WIDTH, CHANNELS)
            d_table = np.zeros_like(net.table)
            np.add.at(d_table, bytes_at, d_window)
            d_table[:, -1] = 0
            adam.t += 1
            adam.step("table", net.table, d_table)
            adam.step("filters", net.filters, d_filters + 1e-5 * net.filters)
            adam.step("bias", net.bias, dh.sum(0))
            adam.step("head", net.head, d_head)
            adam.step("offset", offset, np.array([d.sum()], np.float32))
    net.offset = float(offset[0])
    own = np.flatnonzero(calibrates) if calibrates.any() else learns
    z = np.array([net.logit(texts[k]) for k in own])
    net.slope, net.shift = platt(z, y[own], class_weights(y[own], totals))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Network:
    """Train on at most ``per_class`` labelled documents of each class that are not held out, and ``class_bytes`` of text.

    The sizes of the sampled texts decide on the driver which of them it gets; those it gets are whole, so it learns and
    calibrates on texts as they are scored later. Null and empty texts count as one empty chunk; rows that share an id are
    separate texts; no labels, or those of one class, give a constant.
    """
    rows, totals = labelled_sample(docs, labels, "quality", per_class, learnable_only=True)
    size = F.coalesce(F.length("text"), F.lit(0))
    left, ids = {0: class_bytes, 1: class_bytes}, []
    sizes = rows.groupBy("doc_id", "label").agg(F.sum(size.cast("long")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id")
    for r in sizes.collect():  # at most two rows a sampled document
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            ids.append(r["doc_id"])
    got = sorted((r["doc_id"], r["label"], bytes(r["text"] or b"")) for r in rows.where(F.col("doc_id").isin(ids)).collect())
    return train([r[2] for r in got], np.array([r[1] for r in got], np.float64), totals)


def apply(docs: DataFrame, net: Network, keep: list[str] | None = None, accept_at: float = ACCEPT_AT) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to ``docs``; every text, also null or empty ones, gets a score.

    Rows are scored one by one: null ids (never held out), ties, repeated rows and further columns pass through; columns
    with the names of new ones are replaced; very long texts are scored whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand floats
    kept = None if keep is None else [*keep, "held_out"]

    def score(texts):
        s = [shared.value.probability(t) for t in texts]
        return [s, [int(x >= accept_at) for x in s]]

    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return extend(marked, ["text"], score, "score double, predicted int", keep=kept, most=256)


def accepted(docs: DataFrame, net: Network, accept_at: float = ACCEPT_AT) -> DataFrame:
    """The rows of ``docs`` that the network accepts, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return keep_rows(docs, ["text"], lambda texts: [shared.value.probability(t) >= accept_at for t in texts], most=256)
