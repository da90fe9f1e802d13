"""The trained operators, toxicity (7) and quality (10), against plain versions: all rows in one place, other algorithms."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanpura.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def tables(spark, small):
    docs = queries.table(spark, small, "documents").select("doc_id", "text").toPandas()
    labels = queries.table(spark, small, "labels").toPandas()
    return docs, labels


def plain_statistics(raw):
    """The statistics of a text, one by one."""
    n, words, lines = max(1, len(raw)), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, sizes = max(1, len(words)), [len(x) for x in words] or [0]
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower, high = share(range(65, 91)), share(range(97, 123)), sum(b >= 0x80 for b in raw)
    digits, symbols, exclaims, bars, stops = map(share, (b"0123456789", b"#$%&*~^=<>_@+\\/", b"!", b"|", b".,;:?"))
    other = len(raw) - upper - lower - high - digits - symbols - exclaims - bars - stops - share(b" \t\n\r\x0b\x0c")
    triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    mean = sum(sizes) / len(sizes)
    odd = [x for x in words if not re.search(rb"[^#$%&*!|~^=<>_@+\\/\-.,;:?()\[\]\"'0-9]", x)]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(30, mean), min(30, (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5), np.log1p(max(sizes)),
        upper / max(1, upper + lower + high), digits / n, symbols / n, exclaims / n, bars / n, stops / n, other / n, high / n, np.log1p(len(lines)),
        len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, max(Counter(words).values(), default=0) / w, len(triples) / max(1, len(words) - 2) if len(words) > 2 else 0,
        1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 40 for x in lines) / max(1, len(lines)), sum(x.isupper() and len(x) > 1 for x in words) / w, len(odd) / w,
        len(re.findall(rb"[#$%&*!|~^=<>_@+\\/]{2,}(?=\s|$)", raw)) / w,
    ]


def test_statistics_equal_plain_counts(tables):
    for text in ["", " ", "One two, two! THREE 4 #$ $$% x\n\nshort\nshort\n" * 3, "é ß 日本", *tables[0]["text"].dropna()[:60]]:
        got = np.array(quality.statistics(text.encode()))
        assert got == pytest.approx(np.array(plain_statistics(text.encode()), float), abs=1e-9), text


def rises(x, y):
    """Isotonic regression by its formula: at i, the greatest over a <= i of the least over b >= i of the means of a to b."""
    sums = np.concatenate([[0], np.cumsum(y[0] * y[1])]), np.concatenate([[0], np.cumsum(y[1])])
    n = len(x)
    mean = lambda a, b: (sums[0][b + 1] - sums[0][a]) / (sums[1][b + 1] - sums[1][a])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_quality_equals_a_fit_in_one_place(spark, small, tables):
    """The same random directions; ridge by least squares over stacked rows, calibration by the formula, no partitions."""
    docs, labels = tables
    stats = np.array([quality.statistics((t or "").encode()) for t in docs["text"]], np.float32).astype(float)
    rows = docs.assign(place=range(len(docs))).merge(labels, on="doc_id")
    ids = spark.createDataFrame([(int(i),) for i in rows["doc_id"]], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("fold"), quality.held_out().alias("out")).toPandas()
    rows = rows.merge(ids.drop_duplicates("doc_id"), on="doc_id")
    rows = rows[~rows["out"] & rows["quality"].notna()]
    x, y, fold = stats[rows["place"]], rows["quality"].to_numpy(float), rows["fold"].to_numpy()
    plain = quality.Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))

    def least_squares(keep):
        z = plain.features(x[keep])
        side = np.sqrt(quality.RIDGE / quality.FEATURES) * np.eye(z.shape[1])
        return np.linalg.lstsq(np.vstack([z, side]), np.concatenate([y[keep], np.zeros(len(side))]), rcond=None)[0]

    plain.weights = least_squares(np.ones(len(y), bool))
    raw = np.zeros(len(y))
    for f in np.unique(fold):
        raw[fold == f] = plain.features(x[fold == f]) @ least_squares(fold != f)
    bins = np.floor(np.clip(raw, -0.5, 1.5) * quality.BINS)
    places = np.unique(bins)
    means = np.array([[v[bins == b].mean() for b in places] for v in (raw, y)])
    n = np.array([(bins == b).sum() for b in places], float)
    level = rises(means[0], (means[1], n))
    knots = np.array([np.average(means[0][level == v], weights=n[level == v]) for v in np.unique(level)])
    plain.knots, plain.levels = knots, np.unique(level)
    got = queries.op10_quality(spark, small).toPandas().set_index("doc_id")["score"]
    assert got[docs["doc_id"]].to_numpy() == pytest.approx(plain.score(stats), abs=2e-4)


def test_quality_is_better_than_the_larger_class(spark, small, tables):
    both = queries.op10_quality(spark, small).toPandas().merge(tables[1], on="doc_id")
    unseen = both[both["held_out"]]
    good, bad = unseen[unseen["quality"] == 1], unseen[unseen["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.9 and (bad["predicted"] == 0).mean() > 0.7
    pairs = good["score"].to_numpy()[:, None] - bad["score"].to_numpy()[None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.95


def plain_logistic(x, y):
    """By accelerated gradient steps."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], toxicity.RIDGE * np.sqrt(len(x))), 1e-3)
    step = 1 / (0.25 * np.linalg.eigvalsh(ones.T @ ones).max() + ridge.max())
    w = before = np.zeros(ones.shape[1])
    for i in range(60_000):
        ahead = w + i / (i + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(ones @ ahead, -30, 30)))
        before, w = w, ahead + step * (ones.T @ (y - p) - ridge * ahead)
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def test_toxicity_equals_a_chain_in_one_place(spark, small, tables):
    docs, labels = tables
    toxic, good = labels["toxic"] == 1, labels["quality"] == 1
    rows = docs.merge(labels.assign(y0=toxic & good, y1=toxic & ~good, y2=toxic), on="doc_id")
    y = rows[["y0", "y1", "y2"]].to_numpy(float)
    counts = [Counter(toxicity.words((t or "").encode())) for t in rows["text"]]
    # Copies of one text count once, with the mean of their categories.
    groups = {}
    for t, c, v in zip(rows["text"].fillna(""), counts, y, strict=True):
        groups.setdefault(t, [c, []])[1].append(v)
    texts = [(c, np.mean(v, axis=0)) for c, v in groups.values()]
    total, inside = len(texts), sum(v for _, v in texts)
    gain = {}
    for w in set().union(*(c for c, _ in texts)):
        n, own = sum(w in c for c, _ in texts), sum((v for c, v in texts if w in c), np.zeros(3))
        if n >= toxicity.LEAST_DOCUMENTS:
            best = 0
            for i in range(3):
                table = np.array([[own[i], inside[i] - own[i]], [n - own[i], total - inside[i] - n + own[i]]])
                expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / total
                full = table > 0
                best = max(best, 2 * (table[full] * np.log(table[full] / np.maximum(expected[full], 1e-9))).sum())
            gain[w] = best
    chosen = sorted(w for w, _ in sorted(gain.items(), key=lambda g: (-round(g[1], 9), g[0]))[: toxicity.WORDS])
    chain = toxicity.fit_chain(queries.table(spark, small, "documents"), queries.toxic_categories(queries.table(spark, small, "labels")), queries.TOXIC)
    assert len(set(chosen) & set(chain.place)) >= 0.98 * len(chosen)  # gains may tie at the end
    x = np.array([chain.rates((t or "").encode()) for t in rows["text"]])
    own = np.log1p(100 * np.array([[c[w] for w in chain.place] for c in counts]) / np.array([max(1, sum(c.values())) for c in counts])[:, None])
    assert x == pytest.approx(own)
    known, fold = x, np.array([zlib.crc32(str(i).encode()) % 5 for i in rows["doc_id"]])
    plain = toxicity.Chain(queries.TOXIC, list(chain.place))
    for i in range(3):
        w = plain_logistic(known, y[:, i])
        plain.weights[i] = w
        unseen = np.zeros(len(x))
        for f in range(5):
            unseen[fold == f] = toxicity.probability(known[fold == f], plain_logistic(known[fold != f], y[fold != f, i]))
        known = np.hstack([known, unseen[:, None]])
    plain.fitted = True
    # The folds are dealt otherwise, so probabilities agree closely, not to the last digit.
    assert np.abs(plain.predict(x) - chain.predict(x)).max() < 0.1
    assert ((plain.predict(x)[:, 2] >= 0.5) == (chain.predict(x)[:, 2] >= 0.5)).mean() > 0.99
    # With the same folds they do.
    same = np.array([int.from_bytes(hashlib.md5(str(i).encode()).digest()[:4], "little") % toxicity.FOLDS for i in rows["doc_id"]])
    again = toxicity.Chain(queries.TOXIC, list(chain.place))
    again.fit(x, y, same)
    got = queries.op7_toxicity(spark, small).toPandas().set_index("doc_id").loc[rows["doc_id"]]
    assert got[[f"p_{c}" for c in queries.TOXIC]].to_numpy() == pytest.approx(again.predict(x), abs=1e-3)
