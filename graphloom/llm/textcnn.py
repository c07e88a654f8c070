"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of one table: those of its hash and of the hashes of its first four and five bytes (so
inflections of a stem share weight). Filters of one, two and three words slide over the whole text; each filter's greatest value,
rectified, goes into a logistic output. The table's first dimension starts from document log-odds of each row, the rest small and
random; Adam then trains all weights. Only the places of the maxima carry gradients, so a step costs little beside its forward
pass. Per-language thresholds are the middle of the interval with the best F1 on all labelled rows that were not used in fitting,
those beyond the bound too: scored in Spark, counted by language, score bin and label, and weighted to the labels' whole counts.

The model is fitted on at most ``most_rows`` labelled rows of each label (a documented bound; rows in order of a digest of their
ids) with the logit shifted back to the labels' whole counts. It never sees lang, source or doc_id. Its size is fixed by
parameters, so it can be broadcast.

Defined cases: null or empty text has the score of a text whose filters are all silent; texts shorter than a filter are padded with
zero vectors; repeated rows get equal scores; labels with a null doc_id or null label are skipped, of contradicting ones the
greater counts; with labels of one kind only, or none, every score is the share of label 1 (0 without labels); an empty table gives
an empty result; columns of any name are carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LOWER, prefix_sums, release, slices, span_hash, strings, tidy, tokens
from ._common import cut, unused

ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PAD = ROWS
#: Score bins for a unit of the logit.
BINS = 20


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each place, first place and number of words of each text); two pads follow each text's words."""
    raw, off = strings(column)
    raw = LOWER[raw]
    starts, ends, first = tokens(raw, off)
    sums = prefix_sums(raw)
    words = len(starts)
    ids = np.empty((words, 3), np.int32)
    for k, stop in enumerate((ends, np.minimum(starts + 4, ends), np.minimum(starts + 5, ends))):
        ids[:, k] = (span_hash(sums, starts, stop) + np.uint64(k * 0x9E3779B1)) >> np.uint64(48)
    n = np.diff(first)
    out = np.full((words + 2 * len(n), 3), PAD, np.int32)
    place = np.arange(words) + 2 * np.repeat(np.arange(len(n)), n)
    out[place] = ids
    return out, first[:-1] + 2 * np.arange(len(n)), n


@dataclass
class Model:
    table: np.ndarray
    filters: np.ndarray  # (FILTERS * sum of widths columns) in order of width, then word, then filter
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def pooled(self, ids: np.ndarray, first: np.ndarray, n: np.ndarray, places: bool = False):
        """Greatest value of each filter in each text, before rectifying, and on demand its place and the words' vectors."""
        vec = self.table[ids].sum(1)
        proj = vec @ self.filters
        stops = first + np.maximum(n, 1)
        cuts = np.stack([first, stops], 1).ravel()
        value, at, col = np.empty((len(n), FILTERS * len(WIDTHS)), np.float32), None, 0
        if places:
            at = np.empty(value.shape, np.int64)
        for w, width in enumerate(WIDTHS):
            conv = proj[:, col : col + FILTERS].copy()
            for j in range(1, width):
                conv[:-j] += proj[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
            col += width * FILTERS
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            value[:, own] = np.maximum.reduceat(conv, cuts, axis=0)[::2]
            if places:
                for d, (a, b) in enumerate(zip(first.tolist(), stops.tolist(), strict=True)):
                    at[d, own] = a + conv[a:b].argmax(0)
        return value + self.bias, at, vec

    def score(self, column) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(column), self.constant)
        value, _, _ = self.pooled(*features(column))
        z = np.maximum(value, 0).astype(np.float64) @ self.out + self.base + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7, passes: int = 6, batch: int = 64, rate: float = 0.02) -> Model:
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    parts = [features(pa.array([t], pa.large_string())) for t in texts]
    seen = np.zeros((2, ROWS + 1))
    for (ids, _, _), y in zip(parts, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    p = (seen[1] + 0.5) / (labels.sum() + 1), (seen[0] + 0.5) / (len(labels) - labels.sum() + 1)
    odds = np.where(seen.sum(0) >= 3, np.clip(np.log(p[0] / p[1]), -3, 3), 0)
    table = rng.normal(0, 0.05, (ROWS + 1, DIM)).astype(np.float32)
    table[:, 0] = odds
    table[PAD] = 0
    cols = FILTERS * sum(WIDTHS)
    filters = rng.normal(0, 0.3, (DIM, cols)).astype(np.float32)
    filters[0] = np.abs(filters[0])
    m = Model(table, filters, np.full(FILTERS * len(WIDTHS), -0.5, np.float32), np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))), -2.0)
    weights = {"table": m.table, "filters": m.filters, "bias": m.bias, "out": m.out}
    moment = {k: (np.zeros_like(v, dtype=np.float32), np.zeros_like(v, dtype=np.float32)) for k, v in weights.items()}
    base_moment, step = [0.0, 0.0], 0
    passes = max(passes, -(-300 * batch // len(texts)))  # few rows: as many steps at least
    for turn in range(passes):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            step += 1
            ids = np.concatenate([parts[i][0] for i in chosen])
            n = np.concatenate([parts[i][2] for i in chosen])
            first = np.cumsum(n + 2) - n - 2
            value, at, vec = m.pooled(ids, first, n, places=True)
            hidden = np.maximum(value, 0)
            z = np.clip(hidden @ m.out + m.base, -30, 30)
            err = (1 / (1 + np.exp(-z)) - labels[chosen]) / len(chosen)
            grad = {"out": hidden.T @ err + 1e-5 * m.out, "bias": None, "filters": np.zeros_like(m.filters), "table": None}
            dh = (err[:, None] * m.out) * (value > 0)
            grad["bias"] = dh.sum(0)
            rows, steps_, col = [], [], 0
            for w, width in enumerate(WIDTHS):
                own = slice(w * FILTERS, (w + 1) * FILTERS)
                d, f = np.nonzero(dh[:, own])
                g, where = dh[:, own][d, f].astype(np.float32), at[:, own][d, f]
                for j in range(width):
                    c = col + j * FILTERS + f
                    pos = np.minimum(where + j, len(vec) - 1)
                    np.add.at(grad["filters"].T, c, g[:, None] * vec[pos])
                    rows.append(ids[pos])
                    steps_.append(g[:, None] * m.filters.T[c])
                col += width * FILTERS
            touched, change = np.concatenate(rows), np.concatenate(steps_)
            index, inverse = np.unique(touched.ravel(), return_inverse=True)
            summed = np.zeros((len(index), DIM), np.float32)
            np.add.at(summed, inverse, np.repeat(change, 3, axis=0))
            lr = rate * (1 - turn / passes * 0.8)
            for k in ("out", "bias", "filters"):
                a, b = moment[k]
                a += 0.1 * (grad[k] - a)
                b += 0.01 * (grad[k] ** 2 - b)
                weights[k] -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(weights[k].dtype)
            a, b = moment["table"]
            if len(index):
                a[index] += 0.1 * (summed - a[index])
                b[index] += 0.01 * (summed**2 - b[index])
                m.table[index] -= lr * a[index] / (np.sqrt(b[index]) + 1e-4)
                m.table[PAD] = 0
            g = err.sum()
            base_moment[0] += 0.1 * (g - base_moment[0])
            base_moment[1] += 0.01 * (g * g - base_moment[1])
            m.base -= lr * base_moment[0] / (np.sqrt(base_moment[1]) + 1e-6)
    return m


def best_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, weight: np.ndarray, otherwise: float) -> float:
    """Middle of the widest gap between neighbouring bins with the best F1; ``otherwise`` with fewer than ten rows of a label.
    ``low`` and ``high`` are the least and greatest score of each bin, in descending order, ``n`` its rows of label 0 and 1, ``weight``
    what a row of each label counts."""
    if n.sum(0).min() < 10:
        return otherwise
    zeros, hit = np.cumsum(n * weight, 0).T
    f1 = 2 * hit / (zeros + hit + hit[-1])
    below = np.append(high[1:], 0)
    gap = low - below
    f1[gap <= 0] = -1
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float((low[k] + below[k]) / 2)


def thresholds(scores: DataFrame, labels: DataFrame, counts: tuple[int, int], otherwise: float) -> dict[str, float]:
    """The threshold of each language from all rows of ``scores`` (doc_id, lang, score) that have a row in ``labels`` (doc_id,
    toxic). ``counts`` are the rows of label 0 and 1 that the thresholds are for: rows are weighted to them, as fitting takes another
    share of each label."""
    sure = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = scores.join(labels, "doc_id").withColumn("bin", F.floor(F.log(sure / (1 - sure)) * BINS))
    tally = rows.groupBy("lang", "bin").agg(F.min("score").alias("low"), F.max("score").alias("high"), *[F.count_if(F.col("toxic") == y).alias(f"n{y}") for y in (0, 1)])
    got = tally.orderBy("lang", F.col("bin").desc()).toArrow()
    low, high, n = got.column("low").to_numpy(), got.column("high").to_numpy(), np.stack([got.column(f"n{y}").to_numpy() for y in (0, 1)], 1)
    weight = np.array(counts) / np.maximum(n.sum(0), 1)
    langs = np.array(got.column("lang").to_pylist(), object)
    return {x: best_threshold(low[langs == x], high[langs == x], n[langs == x], weight, otherwise) for x in sorted(set(langs))}


def crc_rest(doc_id: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, threshold: float = 0.3, seed: int = 7) -> tuple[Model, DataFrame]:
    """The model of ``labels`` (doc_id, toxic) on the texts of ``docs``, and (doc_id, lang, score) of all rows. At most ``most_rows``
    rows of each label are used in fitting; the thresholds come from all others."""
    texts_of = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    sums = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sums.get(1, 0), sums.get(0, 0)
    if not ones or not zeros:
        model = Model(*[np.zeros(0)] * 4, 0.0, constant=1.0 if ones else 0.0)
        return model, scored(texts_of, model).drop("text")
    chosen = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "_id"))
    rows = texts_of.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "toxic", "text")
    got = rows.toArrow().sort_by("_id")
    del rows, chosen
    texts, label, ids = got.column("text").to_pylist(), got.column("toxic").to_numpy().astype(np.int64), got.select(["_id"])
    del got
    apart = np.arange(len(texts)) % 5 == 4
    if len(texts) < 50 or not (label[~apart].any() and label[apart].any()):
        apart = np.zeros(len(texts), bool)
    model = train([texts[i] or "" for i in np.flatnonzero(~apart)], label[~apart], seed)
    used = min(ones, most_rows) / min(zeros, most_rows)
    model.shift = float(np.log(ones / zeros) - np.log(used))
    del texts
    release()
    rows = cut(scored(texts_of, model).drop("text"))
    if apart.any():
        fitted = docs.sparkSession.createDataFrame(ids.filter(pa.array(~apart)))
        own = own.join(F.broadcast(fitted), F.col("doc_id") == F.col("_id"), "left_anti")
    model.thresholds = thresholds(rows, own, (zeros, ones), threshold)
    return model, rows


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the model's score of each text; ``text`` must be a string column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text")), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged): rows whose crc32 of the id leaves 2 of 4 are held out of training;
    ``flagged`` uses the threshold of the row's language."""
    model, rows = fit(docs, labels.filter(crc_rest(F.col("doc_id"), 4) != 2), threshold=threshold)
    return rows.select("doc_id", F.coalesce(crc_rest(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), flag(model, threshold).alias("flagged"))


def flag(model: Model, threshold: float, score: str = "score", lang: str = "lang") -> Column:
    limit = F.lit(threshold)
    for name, value in model.thresholds.items():
        limit = F.when(F.coalesce(F.col(lang).cast("string"), F.lit("")) == name, F.lit(value)).otherwise(limit)
    return F.col(score) >= limit


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below their language's threshold."""
    model, _ = fit(docs, labels.filter(crc_rest(F.col("doc_id"), 4) != 2), threshold=threshold)
    (score,) = unused(docs.columns, "_toxic_score")
    return scored(docs, model, score).filter(~flag(model, threshold, score)).drop(score)
