"""Toxicity by a classifier chain.

Categories are predicted one after the other; each link is a linear (logistic) model over word rates and over the
probabilities of the earlier categories. In training those probabilities are out of fold: they come from models that
didn't see the row. Words are lower case letters only, so that case and decoration don't hide them.

A bounded sample of labelled rows is fitted: the FIT_ROWS of smallest hash of their doc_id. The vocabulary is the
WORDS words that tell the sample's categories apart best (G-squared of document counts, those of more copies of one
text counting once). Scoring reads every whole text.

Defined cases: null and empty texts have no words and get the chain's base rates; rows whose categories are null or
whose doc_id has no document aren't fitted; without labelled rows every probability is 0; repeated rows give repeated
rows; an empty table gives an empty result; other columns pass through, those named as outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, mapped, quoted, small_batches, text_bytes

FIT_ROWS, WORDS, FOLDS, RIDGE = 20_000, 256, 5, 0.02
LEAST_DOCUMENTS = 3
NOT_LETTERS = re.compile(r"[\W\d_]+")


def words(raw: bytes) -> list[str]:
    return NOT_LETTERS.sub(" ", raw.decode("utf-8", "replace").lower()).split()


class Chain:
    """The vocabulary and one weight vector for each category: words, earlier categories, constant."""

    def __init__(self, categories: Sequence[str], vocabulary: Sequence[str] = ()):
        self.categories = list(categories)
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.weights = [np.zeros(len(self.place) + i + 1) for i in range(len(self.categories))]
        self.fitted = False

    def rates(self, raw: bytes) -> np.ndarray:
        """log(1 + 100 x share) of each vocabulary word."""
        found = words(raw)
        out = np.zeros(len(self.place))
        for w in found:
            if (i := self.place.get(w)) is not None:
                out[i] += 1
        return np.log1p(100 * out / max(1, len(found)))

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        known = x
        for i in range(len(self.categories)):
            self.weights[i] = logistic(known, y[:, i])
            unseen = np.zeros(len(x))
            for f in np.unique(fold):
                away = fold == f
                unseen[away] = probability(known[away], logistic(known[~away], y[~away, i]))
            known = np.hstack([known, unseen[:, None]])
        self.fitted = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros((len(x), len(self.categories)))
        known = x
        for w in self.weights:
            known = np.hstack([known, probability(known, w)[:, None]])
        return known[:, x.shape[1] :]


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights and constant that minimise the log loss with a ridge on the weights, by Newton's method."""
    if not len(x):
        return np.append(np.zeros(x.shape[1]), -30.0)
    ones = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(ones.shape[1])
    ridge = np.append(np.full(x.shape[1], RIDGE * np.sqrt(len(x))), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -30, 30)))
        step = np.linalg.solve((ones * (p * (1 - p))[:, None]).T @ ones + np.diag(ridge), ones.T @ (y - p) - ridge * w)
        w += step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> Chain:
    """A chain from docs (doc_id, text) and labels (doc_id and a 0/1 column for each category)."""
    whole = labels.where(F.col("doc_id").isNotNull()).dropna(subset=[*categories])
    whole = whole.groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in categories))
    sample = whole.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    chosen = docs.select(F.col("doc_id"), text_bytes().alias("text")).join(F.broadcast(sample), "doc_id")  # at most FIT_ROWS rows
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("word", pa.list_(pa.string())), ("times", pa.list_(pa.int32())), ("total", pa.int64()), ("y", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            targets = list(zip(*(batch.column(c).to_pylist() for c in categories), strict=True))
            for doc_id, raw, y in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), targets, strict=True):
                counts = Counter(words(raw))
                yield from out.add((doc_id, hashlib.md5(raw).digest(), [*counts], [*counts.values()], sum(counts.values()), y), 20 * len(counts))
        yield from out.flush()

    counted = chosen.mapInArrow(run, "doc_id bigint, digest binary, word array<string>, times array<int>, total bigint, y array<double>").persist()
    try:
        # Copies of one text count once; categories of copies are averaged.
        texts = counted.groupBy("digest").agg(F.first("word").alias("word"), *(F.avg(F.col("y")[i]).alias(f"y{i}") for i in range(len(categories))))
        per = texts.select(F.explode("word").alias("word"), *(f"y{i}" for i in range(len(categories))))
        sums = per.groupBy("word").agg(F.count("*").cast("double").alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(len(categories)))).where(F.col("n") >= LEAST_DOCUMENTS)
        totals = texts.agg(F.count("*").alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(len(categories)))).first()
        if not totals["n"]:
            return Chain(categories)
        gains = F.array(*(_gain(F.col(f"y{i}"), F.col("n"), float(totals[f"y{i}"]), float(totals["n"])) for i in range(len(categories))))
        best = sums.withColumn("gain", F.array_max(gains)).orderBy(F.col("gain").desc(), "word").limit(WORDS)
        chain = Chain(categories, sorted(r["word"] for r in best.select("word").collect()))
        entry = F.arrays_zip("word", "times")
        own = F.filter(entry, lambda e: e["word"].isin(list(chain.place))).alias("own")
        rows = counted.orderBy("doc_id", "digest").select("doc_id", own, "total", "y").collect()  # at most FIT_ROWS rows of WORDS numbers
        x, y = np.zeros((len(rows), len(chain.place))), np.array([r["y"] for r in rows]).reshape(len(rows), -1)
        for i, r in enumerate(rows):
            for e in r["own"]:
                x[i, chain.place[e["word"]]] = e["times"]
            x[i] = np.log1p(100 * x[i] / max(1, r["total"]))
        chain.fit(x, y, np.array([int.from_bytes(hashlib.md5(str(r["doc_id"]).encode()).digest()[:4], "little") % FOLDS for r in rows]))
        return chain
    finally:
        counted.unpersist()


def _gain(inside, n, n_in: float, total: float):
    """G-squared of a word's documents inside and outside a category."""
    n_out = total - n_in

    def part(count, expected):
        return F.when(count > 0, 2 * count * F.log(count / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    outside = n - inside
    return part(inside, n_in * n / total) + part(n_in - inside, n_in * (1 - n / total)) + part(outside, n_out * n / total) + part(n_out - outside, n_out * (1 - n / total))


def toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """docs without the text, with p_<category> for each category and toxic: whether the last one's reaches the threshold."""
    outs = [f"p_{c}" for c in chain.categories]

    def make(values: list[bytes]) -> list[pa.Array]:
        p = chain.predict(np.array([chain.rates(t) for t in values]).reshape(len(values), -1))
        return [pa.array(p[:, i], pa.float64()) for i in range(len(outs))]

    rated = mapped(docs, "text", ", ".join(f"{quoted(o)} double" for o in outs), make)
    return rated.withColumn("toxic", (F.col(quoted(outs[-1])) >= threshold).cast("int"))
