"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

A source's documents are dealt into BLOCKS blocks by a hash of their id. A source is taken as many whole times as its
target holds, and once more in part: blocks in hash order until the target is reached, where the last document is
taken in part. Each time a block is taken is a slot; a source's number of slots is its quota. The quotas of all sources
are shared out among the output shards by a tree: at each node, half of the slots go to the left, and how many of those
each source gives is drawn from the multivariate hypergeometric distribution, so that every shard gets whole numbers of
slots that add up to each source's quota. Then each source's slots, permuted by hash, are dealt to the shards as those
numbers say (so no two shards have the same slot), and a shard's documents are shuffled by hash.

At a node, a source's part is drawn given what the sources before it gave. Beyond FAN sources, that is done for groups
of sources first and then within each group, so that one row holds FAN numbers whatever the number of sources.

Only one block of a source is taken in part. It is cut again into BLOCKS parts by the next bits of the hash, of which again
only one is taken in part; its documents alone are brought together and summed up in order, a millionth of the source's.
All other documents are taken whole or not by what is worked out for their block and part, without a shuffle; texts meet
no window but that one, however large or hot a source is. Sources are numbered by ranges and capped
by repeated sums; no task gets all of them.

Defined cases: a null text has size 0 and is never taken; a null source is a source, the last one; a null doc_id is
allowed; equal rows share the hash and may swap places; an empty table gives an empty result. Columns of the input
that clash with output columns are replaced; those that clash with helpers aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.llm.common import fresh, quoted, small_side, stored

BLOCKS, SHARDS, FAN = 1024, 16, 64
WEIGHTS, MOST = (1, 2, 3), 3
WORDS = r"[^\x20\x09-\x0D]+"
#: A document at the end of a source's part is taken whole or not at all, unless that misses the target by more than this share.
MISS = 0.05
#: Pieces of shards for each task that writes the mix, so that tasks are about equal.
PIECES = 8


def size_of(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def hashed(*parts) -> Column:
    """A hash of the parts, of 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def fraction(digits: Column, n: int) -> Column:
    """The first n hexadecimal digits as a number from 0 to under 1."""
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("long") / F.lit(16**n)


def order_key(doc_id: str = "doc_id", seed: int = 0) -> Column:
    """A hash of the id that gives the permuted order and, by its first digits, the block."""
    return hashed(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), seed)


def block_of(key: Column) -> Column:
    return F.floor(fraction(key, 8) * BLOCKS).cast("int")


def part_of(key: Column) -> Column:
    """The part of its block, by the bits after the block's."""
    return (F.floor(fraction(key, 8) * BLOCKS**2) % BLOCKS).cast("int")


def before(column: str, *keys: str, order: tuple = ()) -> Column:
    """The sum of a column's values in the rows before, within keys."""
    return F.coalesce(F.sum(column).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def numbered(sources: DataFrame) -> DataFrame:
    """(key, source_size) with source_no from 1 on, by key with the empty one last: by ranges, and within each of them."""
    last = sources.withColumn("last", F.col("key") == "")
    ranges = stored(last.repartitionByRange("last", "key").withColumn("range", F.spark_partition_id()), "mix-sources")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    first = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    no = F.col("first") + F.row_number().over(W.partitionBy("range").orderBy("last", "key"))
    return ranges.join(F.broadcast(first), "range").select("key", "source_size", no.cast("int").alias("source_no"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds source_no, weight and target to (key, source_size): shares of all words by weight, at most MOST times a source's size.

    The level is what sources get for each unit of weight. Sources that it would bring above their cap get the cap, and
    the level of the others rises, until no more are capped: a job of four sums for each rise.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = stored(numbered(sources).withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(MOST))), "mix-weights")
    share, known = None, -1
    while True:
        capped = F.lit(False) if share is None else share > F.col("cap")
        row = ranked.agg(F.sum("source_size").cast("double").alias("total"), F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(~capped, F.col("weight"))).alias("rest"), F.count_if(capped).alias("n")).first()
        if row["n"] == known:
            break
        share, known = F.col("weight") * F.lit((row["total"] or 0.0) - (row["caps"] or 0.0)) / F.lit(row["rest"] or 1.0), row["n"]
    return ranked.select("key", "source_size", "source_no", "weight", F.least(share, F.col("cap")).alias("target"))


def ln_factorial(x: Column) -> Column:
    """Stirling's series; exact to some 1e-3 from 1 on."""
    y = F.greatest(x.cast("double"), F.lit(1.0))
    return F.when(x < 2, 0.0).otherwise(y * F.log(y) - y + F.log(y * 6.283185307179586) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y))


def hypergeometric(u: Column, good: Column, total: Column, drawn: Column) -> Column:
    """How many of drawn slots, out of total, are among the good ones: the distribution's inverse at u."""
    mean = drawn * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * F.greatest(1 - good / F.greatest(total, F.lit(1)), F.lit(0.0))) * 9 + 5
    low = F.greatest(F.lit(0).cast("long"), drawn + good - total, F.floor(mean - spread))
    high = F.greatest(low, F.least(good, drawn, F.ceil(mean + spread)))
    ways = lambda n, k: ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    chance = lambda k: F.exp(ways(good, k) + ways(total - good, drawn - k) - ways(total, drawn))
    state = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))

    def step(a: Column, k: Column) -> Column:
        now = a["sum"] + chance(k)
        return F.struct(now.alias("sum"), F.when(now < u, F.least(k + 1, high)).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(low, high), state, step, lambda a: a["k"])


ENTRY = "array<struct<member: bigint, quota: bigint, left: bigint>>"


def drawn_left(level: int, seed: int) -> Column:
    """Of node, drawn, total and q (members with their quotas): an array of (member, quota, left), left being how many of the drawn slots each member gives."""
    state = F.struct(F.col("total"), F.col("drawn"), F.array().cast(ENTRY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        u = fraction(hashed(seed, F.col("node"), level, x["member"]), 13)
        here = F.array(hypergeometric(u, x["quota"], a["total"], a["drawn"]))  # in an array, so that it's worked out once

        def taken(k: Column) -> Column:
            one = F.array(F.struct(x["member"].alias("member"), x["quota"].alias("quota"), k.alias("left")))
            return F.struct((a["total"] - x["quota"]).alias("total"), (a["drawn"] - k).alias("drawn"), F.concat(a["out"], one).alias("out"))

        return F.element_at(F.transform(here, taken), 1)

    return F.aggregate("q", state, step, lambda a: a["out"])


def split(quotas: DataFrame, sources: int, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source_no, quota) of as many sources to (source_no, shard, quota): the slots that each shard gets. shards is a power of two."""
    depth = 1
    while FAN**depth < sources:
        depth += 1
    given = [drawn_left(level, seed) for level in range(depth)]  # built once, as an expression is the same at every node
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), (F.col("source_no") - 1).cast("long").alias("member"), F.col("quota").cast("long").alias("quota"))
    for _ in range(shards.bit_length() - 1):
        drawn = None
        for level in range(depth - 1, -1, -1):
            member = F.floor(F.col("member") / FAN**level)
            sums = nodes.groupBy("node", member.alias("member")).agg(F.sum("quota").alias("quota")) if level else nodes
            q = F.sort_array(F.collect_list(F.struct("member", "quota"))).alias("q")  # at most FAN
            groups = sums.groupBy("node", F.floor(F.col("member") / FAN).alias("parent")).agg(q, F.sum("quota").alias("total"))
            groups = groups.withColumn("drawn", F.floor(F.col("total") / 2)) if drawn is None else groups.join(drawn, ["node", "parent"])
            parts = groups.select("node", F.explode(given[level]).alias("e")).select("node", "e.*")
            drawn = parts.select("node", F.col("member").alias("parent"), F.col("left").alias("drawn"))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("quota") - F.col("left")).alias("quota")))
        nodes = parts.select("member", F.explode(halves).alias("h")).select("h.node", "member", "h.quota")
    return nodes.select((F.col("member") + 1).cast("int").alias("source_no"), (F.col("node") - shards).cast("int").alias("shard"), "quota")


def plan(sized: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """For each (key, block): block_size, source_size, target, where the block starts in its source (start), whole times, words of the part (rest), and slots."""
    blocks = stored(sized.groupBy("key", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    per = stored(targets(blocks.groupBy("key").agg(F.sum("block_size").alias("source_size"))), "mix-targets")
    goal = F.floor(F.col("target") + 0.5)
    per_goal = per.withColumn("times", F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int"))
    per_goal = per_goal.withColumn("rest", goal - F.col("times") * F.col("source_size"))
    placed = blocks.withColumn("start", before("block_size", "key", order=("block",))).join(per_goal, "key")
    passes = F.col("times") + F.when((F.col("start") < F.col("rest")) & (F.col("block_size") > 0), 1).otherwise(0)
    placed = stored(placed.withColumn("passes", passes), "mix-placed")
    parts = split(placed.groupBy("source_no").agg(F.sum("passes").alias("quota")), per.count(), shards, seed)
    upto = F.sum("quota").over(W.partitionBy("source_no").orderBy("shard"))
    ends = parts.withColumn("end", upto).groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    slots = placed.where("passes > 0").select("key", "block", "source_no", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    place = F.row_number().over(W.partitionBy("source_no").orderBy(hashed(seed, F.col("source_no"), F.col("block"), F.col("pass"))))
    dealt = slots.withColumn("place", place).join(ends, "source_no")
    shard = F.size(F.filter("ends", lambda e: e["end"] < F.col("place")))
    dealt = dealt.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("slots"))
    return placed.select("key", "block", "block_size", "start", "source_size", "target", "times", "rest").join(dealt, ["key", "block"], "left")


#: What is worked out for each document, beside docs' own columns.
PARTS = ("size", "source_size", "target", "draws")


def drawn(docs: DataFrame, shards: int = SHARDS, seed: int = 0, size: Column | None = None, whole: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with PARTS under names that docs hasn't, and those names. draws: array of (pass, shard, place, words), one for each time that words are taken.

    whole: see MISS.
    """
    helpers = ("key", "order", "block", "piece", "before", "block_size", "start", "times", "rest", "slots", "piece_start", "piece_size")
    named: dict[str, str] = {}
    for n in (*PARTS, *helpers):
        named[n] = fresh(f"mix_{n}", [*docs.columns, *named.values()])
    c = lambda n: F.col(named[n])
    names = [F.col(quoted(n)) for n in docs.columns]
    sized = size_of() if size is None else size
    rows = docs.select(*names, source_key().alias(named["key"]), order_key(seed=seed).alias(named["order"]))
    rows = rows.withColumns({named["block"]: block_of(c("order")), named["piece"]: part_of(c("order"))})
    narrow = stored(rows.select(c("key").alias("key"), c("block").alias("block"), c("piece").alias("piece"), sized.alias("size")), "mix-narrow")
    blocks = stored(plan(narrow, shards, seed), "mix-plan")
    edges = small_side(stored(blocks.where((F.col("start") < F.col("rest")) & (F.col("rest") < F.col("start") + F.col("block_size"))).select("key", "block", "start"), "mix-edges"))
    pieces = narrow.join(edges, ["key", "block"]).groupBy("key", "block", "piece", "start").agg(F.sum("size").alias("piece_size"))
    pieces = stored(pieces.select("key", "block", "piece", "piece_size", (F.col("start") + before("piece_size", "key", "block", order=("piece",))).alias("piece_start")), "mix-pieces")
    own = lambda table: table.select(*(F.col(n).alias(named[n]) for n in table.columns))
    joined = rows.join(own(small_side(blocks)), [named["key"], named["block"]]).join(own(small_side(pieces)), [named["key"], named["block"], named["piece"]], "left")
    begin, length = F.coalesce(c("piece_start"), c("start")), F.coalesce(c("piece_size"), c("block_size"))
    cut = (begin < c("rest")) & (c("rest") < begin + length)
    upto = before(named["size"], named["key"], named["block"], named["piece"], order=(c("order"), F.col("doc_id"), c("size")))
    inside = joined.where(cut).withColumn(named["size"], sized).withColumn(named["before"], upto)
    outside = joined.where(~cut).withColumn(named["size"], sized).withColumn(named["before"], F.lit(0).cast("long"))
    joined = inside.unionByName(outside)
    within = F.greatest(F.lit(0), F.least(c("size"), c("rest") - begin - c("before")))
    part = F.when(cut, within).when(begin < c("rest"), c("size")).otherwise(0).cast("long")
    if whole:
        rounded = F.when(part * 2 >= c("size"), c("size")).otherwise(F.lit(0).cast("long"))
        part = F.when(F.abs(rounded - part) <= c("target") * MISS, rounded).otherwise(part)
    words = lambda s: F.when(s["pass"] <= c("times"), c("size")).otherwise(part)
    draw = lambda s: F.struct(s["pass"].alias("pass"), s["shard"].alias("shard"), F.xxhash64(F.lit(seed), s["shard"], s["pass"], c("order")).alias("place"), words(s).alias("words"))
    slots = F.coalesce(c("slots"), F.array().cast("array<struct<pass: int, shard: int>>"))
    draws = F.filter(F.transform(slots, draw), lambda d: d["words"] > 0)
    made = joined.select(*names, c("size"), c("source_size"), c("target"), draws.alias(named["draws"]))
    return made, {n: named[n] for n in PARTS}


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, taken (words that the mix takes) and draws (pass, shard, place and words of each time).

    docs needs doc_id, source, and text unless a column of sizes is given. Sort a shard's draws by place to shuffle it.
    """
    made, named = drawn(docs, shards, seed, size)
    outs = {n: F.col(named[n]) for n in ("size", "source_size", "target")}
    outs |= {"taken": F.aggregate(named["draws"], F.lit(0).cast("long"), lambda a, d: a + d["words"]), "draws": F.col(named["draws"])}
    return made.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in outs), *(c.alias(k) for k, c in outs.items()))


def mixed_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix: docs' columns, a row for each time that a document is taken, shard by shard and shuffled within each.

    A shard is dealt to several tasks in PIECES for each, by the first bits of a row's place, and each task's rows are in
    the order of shard and place. A document at the end of a source's part is taken whole or not, whichever is nearer to the target; where
    that would miss it by far (MISS), its first words are taken as they stand, with their n_chars.
    """
    made, named = drawn(docs, shards, seed, whole=True)
    draw, piece = fresh("mix_draw", made.columns), fresh("mix_piece", made.columns)
    pieces = max(1, PIECES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    rows = made.withColumn(draw, F.explode(named["draws"]))
    rows = rows.withColumn(piece, F.floor((F.shiftright(F.col(draw)["place"], 32) + (1 << 31)) * pieces / F.lit(1 << 32)))
    rows = rows.repartition(F.col(draw)["shard"], F.col(piece)).sortWithinPartitions(F.col(draw)["shard"], F.col(piece), F.col(draw)["place"], "doc_id")
    words = F.col(draw)["words"]
    whole = words >= F.col(named["size"])
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORDS}"), 0), F.lit(1), words.cast("int")), "")
    text = F.when(whole, F.col("text")).otherwise(first)
    outs = {"text": text}
    if "n_chars" in docs.columns:
        outs["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(outs.get(c, F.col(quoted(c))).alias(c) for c in docs.columns))
