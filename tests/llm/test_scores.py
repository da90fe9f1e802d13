"""Fingerprints (1), HTML extraction (6), toxicity (7), mixing (9) and quality (10)."""

import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tanpura.llm import lineblocks, mixing, omh, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, size_note string, size string, key int, block int, taken int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0.5, "kept", "old", 1, 2, 3) for i, t, s in rows], DOCS)


def plain_sketch(text):
    """Order MinHash by sorting: the same hashes, without the vectorised selection."""
    h = omh.kmer_hashes(text)
    numbered = omh.numbered(h)
    assert len(set(numbered.tolist())) == len(h)
    out = []
    for xor, odd in zip(omh._XOR.ravel().tolist(), omh._ODD.ravel().tolist(), strict=True):
        values = [(((int(x) >> 32) ^ xor) * odd & 0xFFFFFFFF, i) for i, x in enumerate(numbered.tolist())]
        places = sorted(i for _, i in sorted(values)[: omh.TUPLE])
        t = np.zeros(1, np.uint64)
        for p in places:
            t = omh.mixed(t * omh._FACTORS[7] + numbered[p : p + 1])
        out.append(int(t[0] >> np.uint64(32)) | 1)
    return out


@pytest.mark.parametrize("text", ["abc", "hello world, hello world", "x" * 100, "the quick brown fox jumps over the lazy dog " * 9, "é" * 13 + "日本" * 30])
def test_sketch_equals_plain_selection(text):
    assert omh.sketch(text).tolist() == plain_sketch(text)


def test_occurrences_are_numbered(monkeypatch):
    h = np.array([5 << 40, 7 << 40, 5 << 40, 5 << 40], np.uint64)
    first = omh.numbered(h)
    assert len(set(first.tolist())) == 4 and first[0] == h[0] and first[1] == h[1]
    monkeypatch.setattr(omh, "POSITION_BITS", 1)
    assert omh.numbered(h).tolist() == first.tolist()


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    near = base[:1000] + "zzz" + base[1003:]
    moved = base[1500:] + base[:1500]
    a, b, c, d = map(omh.sketch, (base, near, moved, "".join(rng.choice(list("abcdefgh "), 3000))))
    assert omh.likeness(a, b) > 0.8 > omh.likeness(a, c) > omh.likeness(a, d) == 0
    assert not omh.sketch("").any()


FINGER = [(5, "a" * 40, "s"), (3, None, "s"), (9, "hello there, general text of some length", "s"), (2, "", "s"), (None, "last by order, as it has no id", "s"), (7, "short", "s"), (8, "hello there, general text of some length", "s")]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edited_fingerprints(spark, ranges):
    got = {r["doc_id"]: r for r in omh.edited_fingerprints(docs(spark, FINGER).repartition(3), ranges).collect()}
    order = sorted(FINGER, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(FINGER)
    for (i, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == omh.written(omh.sketch(text)) and r["edited_fingerprint"] == omh.written(omh.sketch(edited))
        assert r["near_next"] == omh.likeness(omh.sketch(text), omh.sketch(after))
    assert got[9]["fingerprint"] == got[8]["fingerprint"] and got[9]["near_next"] == 1


def test_repeated_and_null_ids_are_dealt_to_several_ranges(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text number {i} of some words {i * i}", "s") for i in range(240)]
    frame = docs(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"))
    ranged = omh.with_ranges(frame, 8).toPandas()
    per = ranged.groupby(ranged["doc_id"].fillna(-1))["range"].nunique()
    assert per[-1] >= 3 and per[5] >= 3 and ranged.groupby("range").size().max() < 60
    order = frame.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, after = bytes(r["text"]).decode(), bytes(after["text"]).decode()
        want.append((r["doc_id"] or -1, hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest()))
    got = [(r["doc_id"] or -1, r["edited_sha256"]) for r in omh.edited_fingerprints(docs(spark, rows).repartition(3), 8).collect()]
    assert sorted(got) == sorted(want)


def test_fingerprints_of_one_row_and_none(spark):
    one = omh.edited_fingerprints(docs(spark, FINGER[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert omh.edited_fingerprints(docs(spark, FINGER).limit(0)).count() == 0
    plain = omh.fingerprints(docs(spark, FINGER)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in plain}[7] == omh.written(omh.sketch("short")) and plain[0]["lang"] == "en"


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><!-- no --><aside>Side</aside>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text<br>after &eacute; &#233; &lt;tag&gt;<p>Second<div class="ad">Buy</div><form>Name <input></form><ul><li>One<li>Two</ul></article>
<section id="comments"><p>A reader says</p></section><article class="comment"><p>Another</p></article><footer>Foot</footer></body></html>"""


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE, "Title & more\n\nFirst bold text after é é <tag>\n\nSecond\n\nOne\n\nTwo"),
        (None, ""),
        ("", ""),
        ("<p>only", "only"),
        ("plain text", "plain text"),
        ("<article><p>cut &am", "cut &am"),
        ("<nav><a>a</a></nav>", ""),
        ("<div><a href=1>x</a> <a href=2>y</a></div><p>" + "long text " * 20 + "</p><p>more of it, and so on</p><div><a>z</a></div>", ("long text " * 20).strip() + "\n\nmore of it, and so on"),
    ],
)
def test_main_text(page, want):
    assert lineblocks.main_text(page) == want


LONG = "A sentence of the main text that is long enough for a surge, so that windows reach it at once"
INDEX = "".join(f"<p><a href={i}>Source number {i}</a></p>" for i in range(4))


@pytest.mark.parametrize(
    "page,want",
    [
        # Links within the text, with and without an article.
        (f"<article><p>{LONG} 1</p>{INDEX}<p>{LONG} 2</p></article>", 2),
        (f"<div><p>{LONG} 1</p>{INDEX}<p>{LONG} 2</p><p>{LONG} 3</p></div>", 3),
        (f"<div><p>{LONG} 1</p><p>{LONG} 2</p>{INDEX}<p>The end.</p></div>", 2),
        # Teasers in articles beside the text.
        (f"<div><p>{LONG} 1</p><p>{LONG} 2</p></div>{INDEX}<article><p>Teaser</p></article>", 2),
        # Words of classes and ids on text, and names and values of other attributes.
        (f"<article><p class='market-share'>{LONG} 1</p><p id='legal'>{LONG} 2</p></article>", 2),
        (f"<div title='the hidden valley'><p data-id='menu'>{LONG} 1</p><p data-role='banner'>{LONG} 2</p></div>", 2),
        (f"<div><p>{LONG} 1</p><p hidden>{LONG} 2</p><p aria-hidden=true>{LONG} 3</p></div>", 1),
        # A word of class or id on what encloses the article, or most of the text.
        (f"<div class='page sidebar-right'><article><p>{LONG} 1</p></article></div>", 1),
        (f"<div id='sticky-header'><p>{LONG} 1</p><p>{LONG} 2</p><div class='ad'>Buy</div></div>", 2),
    ],
)
def test_line_blocks_keep_every_stretch(page, want):
    got = lineblocks.main_text(page).split("\n\n")
    assert [x for x in got if x.startswith(LONG)] == [f"{LONG} {i + 1}" for i in range(want)]
    assert "Teaser" not in got and "Buy" not in got and ("The end." in got) == ("The end." in page)


def test_pages_without_an_article_element(spark, small):
    """The window sums alone: the same pages with other tags in place of the article's."""
    pages = [r["html"] for r in queries.table(spark, small, "pages").collect()]
    assert all("<article>" in p for p in pages)
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert [lineblocks.main_text(p) for p in plain] == [lineblocks.main_text(p) for p in pages]


@pytest.mark.parametrize("broken", ["<button>{}", "<div>{}|</p></b>{}", "<p><div>|<b>{}|<hr>{}", "<div class=ad>x{}", "<article><p>x{}", "<a href='{}", "<div a=b |c=d {}", "<!-- {}", "<{}"])
def test_cost_follows_a_pages_length(broken):
    def seconds(n):
        page = "".join(part.format("") * (n if "{}" in part else 1) for part in broken.split("|"))
        best = []
        for _ in range(3):
            began = time.process_time()
            lineblocks.main_text(page)
            best.append(time.process_time() - began)
        return min(best)

    assert seconds(40_000) < 0.05 + 3 * 4 * max(seconds(10_000), 0.001)


def test_extraction_over_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = lineblocks.extract(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in sorted(got, key=lambda r: r["page_id"])] == [(1, len(lineblocks.main_text(PAGE))), (2, 0), (2, 0)]
    assert lineblocks.extract(pages.limit(0)).count() == 0


def test_pages_give_their_documents(spark, small):
    rows = queries.op6_lineblocks(spark, small).collect()
    bodies = {" ".join((r["text"] or "").split()) for r in queries.table(spark, small, "documents").collect()}
    own = [" ".join(r["text"].split("\n\n", 1)[-1].split()) for r in rows]
    assert all(t in bodies for t in own)


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 200)), f"s{int(rng.integers(0, 5)) if i % 3 else 9}") for i in range(600)] + [(600, "a b", None), (601, None, "s0"), (None, "x y z", "s1"), (5, "w w", "s2"), (5, "w w", "s2")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["size_note"] == "kept").all()
    per = got.groupby(got["source"].fillna("~")).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["source_size"]).all() and (abs(per["taken"] - per["target"]) <= 0.5).all()
    assert (got["taken"] <= 3 * got["size"]).all() and per["target"].sum() == pytest.approx(per["size"].sum())
    again = mixing.mix(docs(spark, rows).repartition(7)).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["taken"], strict=True)) == sorted(zip(again["doc_id"].fillna(-1), again["taken"], strict=True))


def test_draws_fill_the_quotas_of_the_tree(spark, monkeypatch):
    """Every slot is in one shard; the shards' slots by source are those that the tree gives; totals differ by one at most."""
    given = {}
    split = mixing.split
    monkeypatch.setattr(mixing, "split", lambda *a: given.setdefault("parts", split(*a)))
    rows = docs(spark, [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)])
    draws = mixing.mix(rows).select("source", mixing.block_of(mixing.order_key()).alias("own_block"), F.explode("draws").alias("d")).select("source", "own_block", "d.*").toPandas()
    slots = draws.drop_duplicates(["source", "own_block", "pass", "shard"])
    assert not slots.duplicated(["source", "own_block", "pass"]).any()
    want = {(f"s{r['source_no'] - 1}", r["shard"]): r["quota"] for r in given["parts"].collect()}
    assert slots.groupby(["source", "shard"]).size().to_dict() == {k: n for k, n in want.items() if n}
    per = slots.groupby("shard").size()
    assert len(per) == mixing.SHARDS and per.max() - per.min() <= mixing.SHARDS.bit_length()


@pytest.mark.parametrize("fan", [2, 64])
def test_split_keeps_quotas_and_is_hypergeometric(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    quotas = spark.createDataFrame([(1, 1000), (2, 300), (3, 0), (4, 7)], "source_no int, quota long")
    left = []
    seeds = 30 if fan > 2 else 10
    for seed in range(seeds):
        parts = {(r["source_no"], r["shard"]): r["quota"] for r in mixing.split(quotas, 4, 2, seed).collect()}
        assert {i: parts[i, 0] + parts[i, 1] for i in range(1, 5)} == {1: 1000, 2: 300, 3: 0, 4: 7}
        assert sum(parts[i, 0] for i in range(1, 5)) == 1307 // 2
        left.append(parts[2, 0])
    deviation = (300 * 0.5 * 0.5 * (1000 + 7) / 1306) ** 0.5
    assert abs(np.mean(left) - 150) < 4 * deviation / seeds**0.5 and 0.4 < np.std(left) / deviation < 1.7


def test_many_sources(spark):
    """Beyond one group of the tree, numbered by ranges."""
    got = mixing.mix(docs(spark, [(i, "w " * (1 + i % 5), f"s{i % 150:03}") for i in range(900)])).toPandas()
    per = got.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).reset_index()
    weight, left, rest = np.array([1, 2, 3] * 50), float(per["size"].sum()), 300.0
    capped = np.zeros(150, bool)
    while (more := (weight * left / rest > 3 * per["size"]) & ~capped).any():
        capped |= more
        left, rest = per["size"].sum() - 3.0 * per["size"][capped].sum(), float(weight[~capped].sum())
    assert np.allclose(per["target"], np.where(capped, 3 * per["size"], weight * left / rest))
    assert (abs(per["taken"] - per["target"]) <= 0.5).all()


def test_mixed_rows(spark):
    rows = docs(spark, [(i, f"\n a{i}  b c d", "s1" if i else "s0") for i in range(20)])
    made = mixing.mixed_rows(rows)
    assert made.columns == rows.columns
    taken = mixing.mix(rows).select("doc_id", "size", "taken").toPandas()
    assert {(r["size"], r["key"], r["block"], r["taken"]) for r in made.collect()} == {("old", 1, 2, 3)}
    texts = made.toPandas()
    times = texts.groupby("doc_id").size()
    # s0 gets 3 times its document; of s1, the document at its end is taken whole, as 2 words too many are little.
    assert times[0] == 3 and set(texts["text"]) <= {f"\n a{i}  b c d" for i in range(20)} and abs(len(texts) - 20) <= 1
    assert set(times.index) >= set(taken["doc_id"][taken["taken"] >= 4])
    assert mixing.mixed_rows(rows.limit(0)).count() == 0


def test_the_end_of_a_part_is_cut_only_where_it_misses_by_far(spark):
    made = mixing.mixed_rows(docs(spark, [(0, " one\ttwo\n\nthree  four five six", "a"), (1, "w " * 3, "b")])).toPandas()
    assert sorted(made["text"][made["source"] == "a"]) == [" one\ttwo\n\nthree"] and len(made[made["source"] == "b"]) == 2


def test_mixed_rows_are_shuffled_within_shards(spark):
    rows = docs(spark, [(i, "w " * 5, f"s{i % 4}") for i in range(2000)])
    made = mixing.mixed_rows(rows).select("doc_id", "source", F.spark_partition_id().alias("p")).collect()
    ordered = [(r["p"], r["source"]) for r in made]
    same = np.mean([a == b for a, b in zip(ordered, ordered[1:], strict=False)])
    shares = np.unique([s for _, s in ordered], return_counts=True)[1] / len(ordered)
    assert abs(same - (shares**2).sum()) < 0.05  # as by chance
    plan = mixing.mixed_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_uses_no_python(spark):
    plan = mixing.mix(docs(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_all_zero_sizes(spark):
    got = mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_quality_on_held_out_rows(spark, small):
    got = queries.op10_quality(spark, small).toPandas()
    labels = queries.table(spark, small, "labels").toPandas()
    assert ((zlib.crc32(b"0") % 3 == 1) == got.set_index("doc_id")["held_out"][0]).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.itertuples())
    both = got.merge(labels, on="doc_id")
    unseen = both[both["held_out"]]
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.85
    assert got["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark):
    good, bad = "A calm sentence about rain and fields, written with care. ", "BUY!!! $$$ ### NOW!!! "
    rows = docs(spark, [(i, (good if i % 2 else bad) * (3 + i % 5), "s") for i in range(120)] + [(500, None, "s"), (501, "", "s"), (None, good, "s"), (502, good * 20_000, "s"), (7, good * 5, "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (900, None), (901, 0), (3, 1)], "doc_id long, quality int")
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(120) if i % 2} | {502}
    assert not {r["doc_id"] for r in kept.collect()} & {i for i in range(120) if i % 2 == 0}
    assert quality.keep_good(rows, labels.limit(0)).count() == rows.count()
    assert quality.keep_good(rows.limit(0), labels).count() == 0


def test_isotonic_levels_rise():
    x, y, n = np.arange(6.0), np.array([0.0, 0.5, 0.2, 0.3, 1.0, 0.9]), np.array([1, 1, 1, 2, 1, 1])
    knots, levels = quality.pooled(x, y, n)
    assert (np.diff(levels) > 0).all() and levels[0] == 0 and levels[-1] == pytest.approx(0.95) and len(knots) == 3


def test_toxicity_chain(spark, small):
    got = queries.op7_toxicity(spark, small).toPandas()
    both = got.merge(queries.table(spark, small, "labels").toPandas(), on="doc_id", suffixes=("", "_label"))
    hit = pd.crosstab(both["toxic_label"], both["toxic"])
    assert len(got) == queries.table(spark, small, "documents").count()
    assert hit.loc[0].get(1, 0) <= 0.05 * hit.loc[0].sum() and hit.loc[1].get(1, 0) >= 0.6 * hit.loc[1].sum()


def test_toxicity_of_odd_rows(spark):
    rows = docs(spark, [(i, f"you IDIOT### word{i} more text" if i % 3 == 0 else f"a kind note number{i} of text", "s") for i in range(90)] + [(200, None, "s"), (201, "", "s"), (None, "a kind note", "s"), (202, "idiot " * 50_000, "s")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 6 == 0)) for i in range(90)] + [(None, 1, 1), (300, 1, 1), (4, None, 0)], "doc_id long, rude int, vile int")
    chain = toxicity.fit_chain(rows, labels, ["vile", "rude"])
    got = {r["doc_id"]: r for r in toxicity.toxicity(rows, chain).collect()}
    assert all(got[i]["toxic"] == int(i % 3 == 0) for i in range(90)) and got[202]["toxic"] == 1 and got[200]["toxic"] == got[201]["toxic"] == 0
    assert [len(w) for w in chain.weights] == [len(chain.place) + 1, len(chain.place) + 2]
    nothing = toxicity.fit_chain(rows, labels.limit(0), ["vile", "rude"])
    assert {r["p_rude"] for r in toxicity.toxicity(rows, nothing).collect()} == {0.0}
    assert toxicity.toxicity(rows.limit(0), chain).count() == 0
