"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text (shares of character classes, repetition, lengths) are standardised and turned into
FEATURES cosines whose products approximate a Gaussian kernel. Each partition sums its part of the normal equations,
for each of FOLDS folds; the sums are added up in two levels, and the driver solves systems of FEATURES + 1 unknowns.
Scores of rows by the models that didn't see their fold are binned (BINS) and calibrated by pooling adjacent violators.

Defined cases: null and empty texts have the statistics of an empty text and a score like any other; texts
that aren't UTF-8 are scored by their bytes; labels that are
null or whose doc_id is null or without a document are ignored, repeated labels of a document are averaged; without
labelled rows every score is 0.5; repeated rows give repeated rows; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tanpura.llm.common import fresh, in_arrow, mapped, quoted

FEATURES, FOLDS, BINS, RIDGE, BANDWIDTH = 256, 5, 200, 1.0, 4.0
SALTS = 16
STATISTICS = (
    "log_chars log_words word_length word_spread longest_word upper digits symbols exclaims bars stops other_ascii non_ascii lines "
    "distinct_words same_next top_word distinct_triples same_lines short_lines caps_words odd_words marked_words"
).split()

MARKED = re.compile(rb"[#$%&*!|~^=<>_@+\\/]{2,}(?=\s|$)")
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*~^=<>_@+\\/", b"!", b"|", b".,;:?", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:] = 8
_LETTERS = bytes(range(97, 123))
_CLASS[list(_LETTERS)] = 9


def statistics(raw: bytes) -> list[float]:
    """The STATISTICS of a text in UTF-8."""
    n = max(1, len(raw))
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 10)
    letters = max(1.0, counts[1] + counts[8] + counts[9])
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    again = sum(map(bytes.__eq__, words, itertools.islice(words, 1, None)))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(x.isupper() and len(x) > 1 for x in words)
    odd = sum(not x.strip(b"#$%&*!|~^=<>_@+\\/-.,;:?()[]\"'0123456789") for x in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(30.0, lengths.mean()), min(30.0, lengths.std()), np.log1p(lengths.max()),
        counts[1] / letters, *(counts[2:7] / n), counts[0] / n, counts[8] / n, np.log1p(len(lines)),
        len(seen) / w, again / w, max(seen.values(), default=0) / w, triples / max(1, w - 2), 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 40 for x in lines) / max(1, len(lines)), caps / w, odd / w, len(MARKED.findall(raw)) / w,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with stats array<float>."""
    return mapped(docs, text, "stats array<float>", lambda values: [pa.array([statistics(t) for t in values], pa.list_(pa.float32()))])


class Model:
    """Standardisation, random features, weights and calibration; at most some hundred kB."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.directions = rng.standard_normal((len(mean), FEATURES)) / BANDWIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), len(STATISTICS))


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the bins' means y, of n rows each, on x in rising order: knots and levels."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)) / FEATURES, right)


PART_SQL = "fold int, salt int, sums binary"


def fit(labelled: DataFrame) -> Model:
    """A model from rows with doc_id, stats and label (0 to 1)."""
    known = labelled.where("label is not null").select(F.col("stats"), F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    known = known.persist()
    try:
        moments = [f(F.get("stats", F.lit(i)).cast("double")).alias(f"{name}{i}") for i in range(len(STATISTICS)) for f, name in ((F.avg, "m"), (F.stddev_pop, "s"))]
        first = known.agg(F.count("*").alias("n"), *moments).first()
        if not first["n"]:
            zero = np.zeros(len(STATISTICS))
            return Model(zero, zero + 1)
        read = lambda k: np.array([first[f"{k}{i}"] for i in range(len(STATISTICS))])
        model = Model(read("m"), np.maximum(read("s"), 1e-6))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            sums = {}
            for batch in batches:
                z, y, fold = model.features(matrix(batch.column("stats"))), np.array(batch.column("label")), np.array(batch.column("fold"))
                for f in np.unique(fold):
                    own = np.hstack([z[fold == f], y[fold == f][:, None]])
                    sums[f] = sums.get(f, 0) + own.T @ own
            if sums:
                salt = TaskContext.get().partitionId() % SALTS
                yield pa.record_batch([pa.array([*sums], pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "salt", "sums"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
            return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = known.coalesce(max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(part, PART_SQL)
        summed = parts.groupBy("fold", "salt").applyInArrow(add, PART_SQL).groupBy("fold").applyInArrow(add, PART_SQL)
        side = FEATURES + 2
        sums = {r["fold"]: np.frombuffer(r["sums"], np.float64).reshape(side, side) for r in summed.collect()}  # FOLDS rows
        total = sum(sums.values())
        apart = lambda s: (s[:-1, :-1], s[:-1, -1])
        model.weights = solve(*apart(total))
        others = {f: solve(*apart(total - s)) for f, s in sums.items()}

        def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z, fold = model.features(matrix(batch.column("stats"))), np.array(batch.column("fold"))
                raw = np.array([z[i] @ others[f] for i, f in enumerate(fold)])
                yield pa.record_batch([pa.array(raw, pa.float64()), batch.column("label")], names=["raw", "label"])

        scored = known.mapInArrow(unseen, "raw double, label double").withColumn("bin", F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * BINS))
        bins = scored.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most 2 * BINS + 1 rows
        model.knots, model.levels = pooled(*(np.array([float(r[k]) for r in bins]) for k in "xyn"))
        return model
    finally:
        known.unpersist()


def scored(rows: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """rows (with stats) with the score in place of stats."""
    names = [c for c in rows.columns if c.lower() not in ("stats", score.lower())]
    schema = StructType([*(rows.schema[c] for c in names), StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.score(matrix(batch.column("stats")))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(made, pa.float64())], names=schema.names)

    return in_arrow(rows.select(*(F.col(quoted(c)) for c in names), "stats"), run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels aren't learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def usable(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and label of the documents whose label may be learned from."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg(F.col(column).cast("double")).alias("label"))


def labelled(stats: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Statistics of the documents with a label that may be learned from."""
    return stats.select("doc_id", "stats").join(usable(labels, column), "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns.

    Labels meet their documents before statistics are made, so that no other document is read in full for the fit.
    """
    known = docs.select("doc_id", "text").join(usable(labels), "doc_id")
    model = fit(with_statistics(known))
    score = fresh("score", docs.columns)
    kept = rated(docs, model, score).where(F.col(score) >= threshold)
    return kept.select(*(F.col(quoted(c)) for c in docs.columns))


def rated(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with its score, in one pass and without a shuffle."""
    return mapped(docs, "text", f"{quoted(score)} double", lambda values: [pa.array(model.score(np.array([statistics(t) for t in values], np.float32).astype(np.float64)), pa.float64())], keep_text=True)
