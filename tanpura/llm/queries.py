"""The queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanpura.llm import bpe, grace, lineblocks, mixing, omh, probminhash, quality, repeats, simhash, tokenscan, toxicity, trie, whitening
from tanpura.llm.common import stored


#: Categories of toxicity in the order of the chain: abuse in good text, abuse in poor text, any.
TOXIC = ["toxic_in_good", "toxic_in_poor", "toxic_any"]


def toxic_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the labels quality and toxic."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return labels.select("doc_id", (toxic & good).cast("int").alias(TOXIC[0]), (toxic & ~good).cast("int").alias(TOXIC[1]), toxic.cast("int").alias(TOXIC[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, decoded=True)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chars")


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("spans", "passages", "kept")


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op6_lineblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, toxicity.fit_chain(docs, toxic_categories(table(spark, sf_dir, "labels")), TOXIC))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenscan.document_counts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.size_of().alias("size")), "mix-sizes")
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards")
    return mixing.mix(sized, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", shards)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-statistics")
    model = quality.fit(quality.labelled(stats, table(spark, sf_dir, "labels")))
    rated = quality.scored(stats, model)
    return rated.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_order_minhash, op2_bpe, op3_exact_dedup, op4_suffix_arrays, op5_probminhash, op6_lineblocks, op7_toxicity, op8_token_counts, op9_mixing, op10_quality, op11_simhash, op12_trie, op13_whitening]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size,
  row_number() over w = 1 as kept, sha256(bare) as text_sha256
from t window w as (partition by bare order by n desc, doc_id nulls last)
"""

def ln_factorial_sql(x: str) -> str:
    y = f"cast(greatest({x}, 1) as double)"
    return f"(case when {x} < 2 then 0 else {y} * ln({y}) - {y} + ln({y} * 6.283185307179586::double) / 2 + 1 / (12 * {y}) - 1 / (360 * {y} * {y} * {y}) end)"


def ways_sql(n: str, k: str) -> str:
    return f"({ln_factorial_sql(n)} - {ln_factorial_sql(k)} - {ln_factorial_sql(f'({n} - {k})')})"


def tree_sql(level: int) -> str:
    """The quotas of the nodes of one level halved, source after source: r{level}, and those of the next level, n{level + 1}."""
    chance = f"exp({ways_sql('quota', 'k')} + {ways_sql('(total - quota)', '(drawn - k)')} - {ways_sql('total', 'drawn')})"
    return f"""
r{level} as (
  select node, 0 as no, cast(sum(quota) as bigint) as total, cast(sum(quota) as bigint) // 2 as drawn, cast(0 as bigint) as quota, cast(0 as bigint) as k from n{level} group by node
  union all
  select node, no, total - quota as total, drawn - k as drawn, quota, k from (
    select *, least(high, low + len(list_filter(range(1, len(chances) + 1), lambda i: list_sum(chances[:i]) < u))) as k from (
      select *, list_transform(range(low, high + 1), lambda k: {chance}) as chances from (
        select *, greatest(low, least(quota, drawn, cast(ceil(mean + spread) as bigint))) as high from (
          select *, greatest(0, drawn + quota - total, cast(floor(mean - spread) as bigint)) as low from (
            select *, sqrt(mean * greatest(1 - cast(quota as double) / greatest(total, 1), 0.0::double)) * 9 + 5 as spread from (
              select r.node, n.no, r.total, r.drawn, n.quota, cast(r.drawn * n.quota as double) / greatest(r.total, 1) as mean,
                cast(cast('0x' || substr(md5('0:' || r.node || ':0:' || (n.no - 1)), 1, 13) as ubigint) as double) / 4503599627370496 as u
              from r{level} r join n{level} n on n.node = r.node and n.no = r.no + 1))))))),
n{level + 1} as (
  select node * 2 as node, no, k as quota from r{level} where no > 0 union all select node * 2 + 1, no, quota - k from r{level} where no > 0)"""


#: Targets by water filling, then the splitting tree and what of each document's draws falls to which shard. As many
#: sources as one group of the tree holds (mixing.FAN); more would need the tree over groups.
OP9_SQL = rf"""
with recursive d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), 'null') || ':0') as k from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight,
    cast(row_number() over (order by source nulls last) as int) as n from d group by source),
c as (
  select *, cast(3 * source_size as double) as cap, cast(weight as double) as wt from s),
l as (
  select *, cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by cap / wt, n rows between unbounded preceding and 1 preceding), 0) as lft,
    sum(wt) over (order by cap / wt, n rows between current row and unbounded following) as rst from c),
f as (
  select *, wt * lft / rst > cap as capped from l),
g as (
  select arg_min(lft, cap / wt) as lft, arg_min(rst, cap / wt) as rst from f
  where not capped and n = (select arg_min(n, struct_pack(a := cap / wt, b := n)) from f where not capped)),
t as (
  select f.n, f.source, f.source_size, case when f.capped then f.cap else f.wt * g.lft / g.rst end as target from f, g),
w as (
  select *, case when source_size = 0 then 0 else goal // source_size end as times, goal - case when source_size = 0 then 0 else goal // source_size end * source_size as rest
  from (select *, cast(floor(target + 0.5) as bigint) as goal from t)),
p as (
  select d.doc_id, d.size, w.n, w.source_size, w.target, w.times, cast(floor(cast('0x' || substr(d.k, 1, 8) as ubigint) / 4294967296 * 1024) as int) as block,
    greatest(0, least(size, rest - coalesce(sum(d.size) over (partition by w.n order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0))) as part, w.rest
  from d join w on d.source is not distinct from w.source),
b as (
  select n, block, times + case when start < rest and block_size > 0 then 1 else 0 end as passes from (
    select *, coalesce(sum(block_size) over (partition by n order by block rows between unbounded preceding and 1 preceding), 0) as start from (
      select n, block, any_value(times) as times, any_value(rest) as rest, sum(size) as block_size from p group by n, block))),
n0 as (
  select cast(1 as bigint) as node, n as no, cast(sum(passes) as bigint) as quota from b group by n),
{','.join(tree_sql(level) for level in range(mixing.SHARDS.bit_length() - 1))},
e as (
  select no, node - {mixing.SHARDS} as shard, sum(quota) over (partition by no order by node) as upto from n{mixing.SHARDS.bit_length() - 1}),
slots as (
  select n, block, pass, row_number() over (partition by n order by md5('0:' || n || ':' || block || ':' || pass)) as place
  from (select n, block, unnest(range(1, passes + 1)) as pass from b)),
dealt as (
  select slots.n, slots.block, slots.pass, count(e.shard) as shard from slots left join e on e.no = slots.n and e.upto < slots.place group by all),
drawn as (
  select p.n, p.block, p.doc_id, p.size, string_agg(cast(dealt.shard as varchar), ',' order by dealt.pass) as shards
  from (select distinct n, block, doc_id, size, times, part from p) p join dealt on dealt.n = p.n and dealt.block = p.block
  where case when dealt.pass <= p.times then p.size else p.part end > 0 group by all)
select p.doc_id, p.size, p.source_size, p.target, cast(case when p.source_size = 0 then 0 else p.times * p.size + p.part end as bigint) as taken, coalesce(drawn.shards, '') as shards
from p left join drawn on drawn.n = p.n and drawn.block = p.block and drawn.doc_id is not distinct from p.doc_id and drawn.size = p.size
"""


#: The CRC of a decimal number byte by byte from its table, the rebuilt conversations, and nodes named by all their turns' digests.
OP12_SQL = r"""
with recursive bits as (
  select range as i, range as c, 0 as k from range(256)
  union all
  select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8),
crc as (
  select i, c from bits where k = 8),
own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
    md5(coalesce(role, '') || chr(0) || coalesce(text, '')) as said, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null),
n as (
  select conv_id, max(pos) as n, conv_id - conv_id % 5 as base from own group by conv_id),
walk as (
  select conv_id, cast(conv_id as varchar) as s, 1 as place, cast(4294967295 as bigint) as c from n
  union all
  select conv_id, s, place + 1, xor(walk.c // 256, crc.c) from walk join crc on crc.i = xor(walk.c % 256, ord(substr(s, place, 1))) where place <= length(s)),
heads as (
  select n.conv_id, n.base, xor(c, 4294967295) % 9 as h, least(xor(c, 4294967295) % 9, coalesce(b.n, 0)) as m
  from walk join n using (conv_id) left join n b on b.conv_id = n.base where place > length(s)),
turns as (
  select heads.conv_id, pos as depth, said, bytes from heads join own on own.conv_id = base where pos <= m
  union all
  select heads.conv_id, pos - h + m, said, bytes from heads join own using (conv_id) where pos > h
  union all
  select conv_id, 0, '', 0 from heads),
way as (
  select *, string_agg(said, '') over (partition by conv_id order by depth rows unbounded preceding) as node, depth = max(depth) over (partition by conv_id) as ends from turns),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as members
  from way group by node, depth),
kids as (
  select left(node, 32 * (depth - 1)) as node, count(*) as n_children from nodes where depth > 0 group by all),
sums as (
  select left(node, 32 * up) as node, count(*) filter (n_children is null) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens
  from (select nodes.*, n_children, unnest(range(nodes.depth + 1)) as up from nodes left join kids using (node)) group by left(node, 32 * up))
select nodes.conv_id, cast(nodes.depth as bigint) as depth, p.conv_id as parent_conv_id, nodes.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(nodes.members) as ends_sha256
from nodes left join kids using (node) join sums using (node) left join nodes p on p.node = left(nodes.node, 32 * (nodes.depth - 1)) and p.depth = nodes.depth - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op9_mixing": OP9_SQL, "op12_trie": OP12_SQL}
