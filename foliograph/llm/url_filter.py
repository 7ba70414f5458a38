"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give every URL a length-normalised
log-likelihood difference from exact counts, looked up by key; a calibration turns it into the probability of rejection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import class_weights, platt, stored, unused

#: (host and path prefix, verdict) in order.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts holding one of these words count as rejected when learning (a parameter). Others count as accepted unless a rule
#: blocks them: most of the web is, and one that is not stands out all the same. What rules block without such a word says
#: nothing of the rest (rules block by country or language), so it is not learned from.
SEEDS = ("adult", "bets", "casino", "ads-", "pills", "porn", "spam", "viagra", "xxx")
#: Longest context of the Markov models and weight of the shorter context.
ORDER, BACK_OFF = 4, 2.0
#: Rows (a power of two) that look up their grams together, and grams a task adds up before it passes them on.
BLOCK_BITS, HELD_GRAMS = 14, 1 << 20
BLOCK_AT = 0.5
#: URLs of each class that calibrate (the documented bound); they are not counted in the models.
CALIBRATION = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams (``ORDER`` bytes of context and the next byte, packed into 40 bits) of all places, and how many each URL has."""
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    c = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    g = np.zeros(max(0, len(c) - ORDER), np.int64)
    for k in range(ORDER + 1):
        g = g << 8 | c[k : k + len(g)]
    return g[np.arange(sizes.sum()) + np.repeat(ORDER * np.arange(len(urls)), sizes)], sizes


def _sums(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(2, wanted): the sums of both classes' counts ``n`` over the rows that have the wanted key."""
    if not len(keys):
        return np.zeros((2, len(wanted)))
    own, place = np.unique(keys, return_inverse=True)
    total = np.array([np.bincount(place, x, len(own)) for x in n])
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return np.where(own[at] == wanted, total[:, at], 0)


def _log_ratios(grams: np.ndarray, n: np.ndarray, low: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """log P(rejected) - log P(accepted) of the last byte of every wanted gram after its context.

    ``grams`` and ``n`` are all counts that share the last two bytes of context of a wanted one, ``low`` the counts of both
    classes by last byte of context and next byte.
    """
    last, x = wanted >> 8 & 255, wanted & 255
    p = (low.sum(1)[:, x] + BACK_OFF / 256) / (low.sum((1, 2))[:, None] + BACK_OFF)
    p = (low[:, last, x] + BACK_OFF * p) / (low.sum(2)[:, last] + BACK_OFF)
    for k in range(2, ORDER + 1):
        mask = (1 << 8 * (k + 1)) - 1
        p = (_sums(grams & mask, n, wanted & mask) + BACK_OFF * p) / (_sums((grams & mask) >> 8, n, (wanted & mask) >> 8) + BACK_OFF)
    return np.log(p[1]) - np.log(p[0])


@dataclass(frozen=True)
class UrlModel:
    counts: DataFrame  # gram, n0, n1: exact counts of accepted and rejected URLs, a table that grows with the input
    low: np.ndarray  # (2, 256, 256): the same by last byte of context and next byte
    slope: float = 1.0
    shift: float = 0.0


def _differences(urls: DataFrame, model: UrlModel) -> DataFrame:
    """(rid, difference): mean over the places of a URL ``u`` of log P(rejected) - log P(accepted).

    A place's share depends on its gram alone. So every block of rows asks once for each of its grams, the counts answer
    by key, and the block adds up the answers. ``urls`` (rid, u) has to give the same rows whenever it is read.
    """
    low, spark = model.low, urls.sparkSession
    urls = urls.select("rid", F.shiftright("rid", BLOCK_BITS).alias("block"), "u")

    def ask(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                own = _grams(batch.column(1).filter(pa.array(blocks == block)).to_pylist())[0]
                if block not in held and held:
                    yield from flush(held)
                    held = {}
                held[block] = np.union1d(held.get(block, own[:0]), own)
        yield from flush(held)

    def flush(held):
        for block, grams in held.items():
            for at in range(0, len(grams), 50_000):
                g = grams[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block, np.int64)), pa.array(g)], names=["block", "gram"])

    def answer(counts: pa.Table, asked: pa.Table) -> pa.Table:
        g, n = counts["gram"].to_numpy(), np.array([counts["n0"].to_numpy(), counts["n1"].to_numpy()], np.float64)
        wanted = asked["gram"].to_numpy()
        return pa.table({"gram": pa.array(wanted), "value": pa.array(_log_ratios(g, n, shared.value, wanted), pa.float64())})

    def add_up(rows: pa.Table, values: pa.Table) -> pa.Table:
        g, sizes = _grams(rows["u"].to_pylist())
        if not len(sizes):
            return pa.table({"rid": pa.array([], pa.int64()), "difference": pa.array([], pa.float64())})
        order = np.argsort(values["gram"].to_numpy())
        known, value = values["gram"].to_numpy()[order], values["value"].to_numpy()[order]
        total = np.add.reduceat(value[np.searchsorted(known, g)], np.cumsum(sizes) - sizes)
        return pa.table({"rid": rows["rid"].combine_chunks(), "difference": pa.array(total / sizes)})

    shared = spark.sparkContext.broadcast(low)  # 2 * 256 * 256 doubles
    asked = stored(urls.select("block", "u").mapInArrow(ask, "block long, gram long"), "asked")
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    values = model.counts.groupBy(pair.alias("pair")).cogroup(asked.select("gram").distinct().groupBy(pair.alias("pair"))).applyInArrow(answer, "gram long, value double")
    answered = asked.join(values.hint("merge"), "gram")
    return urls.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(add_up, "rid long, difference double")


def judged_of(url: Column) -> Column:
    """What the models judge: the whole url after its ``://`` with the host lower-cased, or all of a url without one."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(host_of(url), tail)).otherwise(url), F.lit(""))


def located(pages: DataFrame, rules=RULES, said: str = "said") -> DataFrame:
    """Add ``host``, ``path`` and ``rule`` to ``pages``, and the rule's verdict as ``said``."""
    parts = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumn("rule", rule).withColumn(said, verdict)


def _labelled(pages: DataFrame, rules, seeds) -> DataFrame:
    """(u, k): the judged part of every url that is learned from, and 1 if it counts as rejected, else 0."""
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | F.col("host").contains(word)
    k = F.when(seeded, 1).when((F.col("host") != "") & ~F.col("said").eqNullSafe("block"), 0)
    parts = located(pages.select("url"), rules).select(judged_of(F.col("url")).cast("binary").alias("u"), k.cast("int").alias("k"))
    return parts.where(F.col("k").isNotNull())


def fit(pages: DataFrame, rules=RULES, seeds=SEEDS) -> UrlModel:
    """Count the grams of all URLs with a class (see ``SEEDS``), as accepted or rejected, but for the rows that calibrate.

    Those are at most ``CALIBRATION`` of each class, from a fifth by crc32. Tasks add up their own counts before the
    shuffle; the driver gets the counts of two bytes only.
    """
    known = _labelled(pages, rules, seeds)
    held = known.where(F.crc32("u") % 5 == 0)
    sample = [(bytes(r["u"]), r["k"]) for k in (0, 1) for r in held.where(F.col("k") == k).orderBy(F.xxhash64("u"), "u").limit(CALIBRATION).collect()]

    def flush(keys, n):
        for at in range(0, len(keys), 50_000):
            g, k, m = keys[at : at + 50_000] >> 1, keys[at : at + 50_000] & 1, n[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.where(k == 0, m, 0)), pa.array(np.where(k == 1, m, 0))], names=["gram", "n0", "n1"])

    def count(batches, sign=1):
        keys = n = np.zeros(0, np.int64)
        for batch in batches:
            grams, sizes = _grams(batch.column(0).to_pylist())
            new, times = np.unique(grams << 1 | np.repeat(batch.column(1).to_numpy().astype(np.int64), sizes), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, n = both, np.bincount(place, np.concatenate([n, sign * times]), len(both)).astype(np.int64)
            if len(keys) > HELD_GRAMS:
                yield from flush(keys, n)
                keys = n = np.zeros(0, np.int64)
        yield from flush(keys, n)

    spark, columns = pages.sparkSession, "gram long, n0 long, n1 long"
    rows = spark.createDataFrame(sample, "u binary, k int")
    grams = known.mapInArrow(count, columns).unionByName(rows.mapInArrow(lambda batches: count(batches, -1), columns))
    counts = stored(grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 > 0 OR n1 > 0"), "counts")
    low = np.zeros((2, 256 * 256))
    two = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("two")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    low[:, two["two"].to_numpy(np.int64)] = two["n0"], two["n1"]
    model = UrlModel(counts, low.reshape(2, 256, 256))
    if not sample:
        return model
    found = dict(_differences(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(sample)], "rid long, u binary"), model).collect())
    z, y = np.array([found[i] for i in range(len(sample))]), np.array([k for _, k in sample], np.float64)
    shares = {r["k"]: r["count"] for r in held.groupBy("k").count().collect()}
    return UrlModel(counts, model.low, *platt(z, y, class_weights(y, shares)))


def apply(pages: DataFrame, model: UrlModel, rules=RULES, keep: list[str] | None = None, block_at: float = BLOCK_AT) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``reject_probability`` to ``pages``.

    A null url or one without ``://`` has empty host and path and no rule; a null or empty one says nothing for itself, and
    the method blocks it. Rows are judged one by one: null ids, ties, repeated rows, very long urls and further columns pass
    through, whatever their names; columns with the names of new ones are replaced; an empty table stays empty. The rows are
    written once, numbered, so that their scores can be joined to them.
    """
    new = ("host", "path", "rule", "verdict", "reject_probability")
    own = [c for c in pages.columns if c.lower() not in new and (keep is None or c in keep)]
    rid, u, said = unused(pages, "rid", "judged", "said")
    parts = located(pages, rules, said).withColumn(u, judged_of(F.col("url")).cast("binary"))
    parts = stored(parts.select(*(F.col(f"`{c}`") for c in own), "host", "path", "rule", u, said, F.monotonically_increasing_id().alias(rid)), "numbered")
    urls = parts.where(F.length(u) > 0).select(F.col(rid).alias("rid"), F.col(u).alias("u"))
    z = F.lit(model.slope) * F.col("difference") + F.lit(model.shift)
    z = F.when(z > 30, 30.0).when(z < -30, -30.0).otherwise(z)
    scores = _differences(urls, model).select(F.col("rid").alias(rid), (1 / (1 + F.exp(-z))).alias("reject_probability"))
    scored = parts.join(scores.hint("merge"), rid, "left").withColumn("reject_probability", F.coalesce("reject_probability", F.lit(1.0)))
    verdict = F.coalesce(said, F.when(F.col("reject_probability") >= block_at, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*(F.col(f"`{c}`") for c in own), *new)
