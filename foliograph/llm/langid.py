"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, held_out

ORDERS = (1, 2, 3)
BUCKETS = 1 << 13
#: Added to every bucket's count of every language.
SMOOTHING = 0.5
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    """Whether a text has a character that Unicode calls a letter (digits, fractions and the like are none)."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def counts(text: bytes) -> np.ndarray:
    """Bucket counts of the lower-cased text's character 1- to 3-grams; runs of white space are one space."""
    s = " " + " ".join(text.decode("utf-8", "replace").lower().split()) + " "
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    grams, h = [], c.copy()
    for k in ORDERS:
        if k > 1:
            if len(c) < k:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[k - 1 :]
        grams.append((h * np.uint32(2654435761) + np.uint32(k * 0x3779B1)) >> np.uint32(19))
    return np.bincount(np.concatenate(grams), minlength=BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # (BUCKETS, languages)
    prior: np.ndarray

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability: the text's sparse counts times the log-probabilities."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, t in enumerate(texts):
            if not t or not self.languages or not has_letter(t):
                continue
            c = counts(t)
            at = np.flatnonzero(c)
            z = c[at] @ self.log_probability[at] + self.prior
            p = np.exp(z - z.max())
            best = int(p.argmax())
            names[k], scores[k] = self.languages[best], float(p[best] / p.sum())
        return names, scores


def fit(docs: DataFrame, column: str = "lang") -> LanguageModel:
    """Count the n-grams of all documents that are not held out and have a language and a text.

    Every task adds up its texts by language, so the shuffle holds at most ``BUCKETS`` counts a language and task, and the
    driver gets ``BUCKETS`` a language.
    """
    known = docs.where(F.col(column).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def add_up(batches):
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in total:
                        total[lang], docs_of[lang] = np.zeros(BUCKETS, np.int64), 0
                    total[lang] += counts(text)
                    docs_of[lang] += 1
        for lang, c in total.items():
            nz = np.flatnonzero(c)
            columns = [pa.array([lang] * (len(nz) + 1)), pa.array([-1, *nz], pa.int32()), pa.array([docs_of[lang], *c[nz]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    sums = known.select(F.col("text").cast("binary"), F.col(column).cast("string")).mapInArrow(add_up, "lang string, bucket int, n long")
    rows = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    table, prior = np.full((BUCKETS, len(names)), SMOOTHING), np.zeros(len(names))
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        grams = own[own["bucket"] >= 0]
        table[grams["bucket"].to_numpy(), k] += grams["n"].to_numpy()
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
    if names:
        table, prior = np.log(table / table.sum(0)), np.log(prior / prior.sum())
    return LanguageModel(tuple(names), table, prior)


def apply(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score`` to ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is all if nothing could be learned; very long texts
    are read whole. Rows are judged one by one: null ids (never held out), ties, repeated rows and further columns pass
    through; columns with the names of new ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles a language
    kept = None if keep is None else [*keep, "held_out"]
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return extend(marked, ["text"], lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double", keep=kept, most=128)
