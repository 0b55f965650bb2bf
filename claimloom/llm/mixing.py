"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

1. Sources share all words by weight; a target stops at `cap` times its source's size and the excess is reshared by weight
   among the others until none is above. That is one level for all: target = least(cap * size, level * weight).
2. A source's documents, in the order of a hash, laid end to end and repeated, are its stream. Its first `target` words are
   taken, in blocks of `block` words: every block of the quota is drawn, none twice. A document belongs to the block in which
   it starts, so documents stay whole, but for the one that the quota ends in.
3. The quotas are split among output shards by a binary tree. A node halves its shards and draws how many blocks of each
   source go left from the multivariate hypergeometric distribution, given that both sides fill: source after source, each
   from the hypergeometric distribution that the sources before it leave. Quotas stay exact at every node.
4. A source's blocks are permuted (swap-or-not rounds, a bijection of any number of blocks), and its shards take consecutive
   ranges of the permuted order, so their draws are disjoint. Within a shard, draws are ordered by a hash.

What a document gives to the mix is what the shards draw of it: a block that no shard drew would be missing from `taken`.
A document's place in its stream is a prefix sum: over the sums of hash ranges of its source, each of RANGE_ROWS documents or
less, then within its range. No task holds a source. The tree's state is a row for each node with one number for each source,
and targets are settled in one task over one row for each source: sources are to be few (a million, say) beside documents.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order. Repeated rows
are documents of their own. A source of no words has target 0. An empty table gives an empty result. Everything follows
from hashes of id and text with a fixed seed, so reruns agree. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SHARDS, BLOCK, SEED = (5, 2, 1), 3, 16, 1024, 17
#: Rows of a hash range, about, and the fewest ranges.
RANGE_ROWS, RANGES = 1 << 16, 1 << 12
#: Rounds of the permutation of blocks.
SWAPS = 32
#: Standard deviations from the mode beyond which a draw's chances, under 1e-30 together, are below a double's resolution.
REACH = 12


def word_count(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, place, source_size, target, quota (target in whole words) from (source, source_size)."""
    every = Window.partitionBy(F.lit(0))
    placed = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    ratio = weighed.withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    before = every.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    full, spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap, F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ratio.withColumn("level", (total - full) / (weight - spent))
    # the sources before the first whose ratio the level doesn't pass are full
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    target = F.least((F.col("source_size") * cap).cast("double"), fits["level"] * F.col("weight"))
    known = level.withColumn("target", F.coalesce(target, (F.col("source_size") * cap).cast("double")))
    return known.select("source", "place", "source_size", "target", F.round("target").cast("long").alias("quota"))


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _drawn(uniform: str) -> str:
    """SQL for a hypergeometric draw: of h.pop blocks h.own are the source's, h.draws go left. Inverse CDF outward from the mode.

    It walks as far as chances count in double precision, so its length grows with the root of the number of blocks.
    """
    up = "p * cast((h.own - i) as double) * (h.draws - i) / ((i + 1.0d) * (h.pop - h.own - h.draws + i + 1))"
    down = "p * cast(i as double) * (h.pop - h.own - h.draws + i) / ((h.own - i + 1.0d) * (h.draws - i + 1))"
    up, down = (x.replace("p *", "a.p *", 1) for x in (up, down))
    ups, downs = ("if({0} > g.{1}, sequence(g.{1}, {0} - 1), cast(array() as array<bigint>))".format("g.high", "mode"), "if(g.mode > g.low, sequence(g.mode, g.low + 1, -1), cast(array() as array<bigint>))")

    def mass(places: str, step: str) -> str:
        return f"aggregate({places}, named_struct('p', 1.0d, 'sum', 0.0d), (a, i) -> named_struct('p', {step}, 'sum', a.sum + {step}), a -> a.sum)"

    def pick(places: str, step: str, change: int, start: str, goal: str) -> str:
        return (
            f"aggregate({places}, named_struct('p', 1.0d, 'sum', {start}, 'at', cast(null as bigint)), (a, i) -> named_struct('p', {step}, 'sum', a.sum + {step}, "
            f"'at', coalesce(a.at, if(a.sum + {step} >= {goal}, i + {change}, null))), a -> a.at)"
        )

    walk = _let(
        "m",
        f"named_struct('up', {mass(ups, up)}, 'down', {mass(downs, down)})",
        _let(
            "goal",
            f"{uniform} * (1 + m.up + m.down)",
            f"if(goal <= 1, g.mode, coalesce({pick(ups, up, 1, '1.0d', 'goal')}, {pick(downs, down, -1, '1 + m.up', 'goal')}, g.mode))",
        ),
    )
    spread = "sqrt(greatest(0.0d, cast(h.draws as double) * h.own / h.pop * (1 - cast(h.own as double) / h.pop) * (h.pop - h.draws) / greatest(1, h.pop - 1)))"
    bounds = (
        f"named_struct('mode', f.mode, 'low', greatest(f.low, f.mode - cast({REACH} * f.sd as bigint) - 10), 'high', least(f.high, f.mode + cast({REACH} * f.sd as bigint) + 10))"
    )
    frame = (
        "named_struct('low', greatest(0L, h.draws - (h.pop - h.own)), 'high', least(h.own, h.draws), "
        f"'mode', greatest(greatest(0L, h.draws - (h.pop - h.own)), least(least(h.own, h.draws), cast(floor((h.draws + 1.0d) * (h.own + 1) / (h.pop + 2)) as bigint))), 'sd', {spread})"
    )
    return f"if(h.pop = 0, 0L, {_let('f', frame, _let('g', bounds, walk))})"


def permuted(block: str, blocks: str, seed: int) -> str:
    """SQL for the place of a block among the permuted blocks of the source numbered `place`: a bijection for any number of blocks.

    Each round pairs x with key - x and swaps the two, or not, by a hash of the pair (the swap-or-not shuffle).
    """
    other = f"pmod(pmod(xxhash64({seed}, place, t), {blocks}) + {blocks} - x, {blocks})"
    return f"aggregate(sequence(0, {SWAPS - 1}), {block}, (x, t) -> {_let('y', other, f'if((xxhash64({seed}, place, t, greatest(x, y)) & 1) = 1, y, x)')})"


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """place, ends: how many of the source's permuted blocks go to the shards up to each. sources: place, blocks."""
    nodes = sources.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("quota"))
    nodes = stored(nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "quota"))
    while shards > 1:
        shards = (shards + 1) // 2
        chance = lambda salt: f"((shiftrightunsigned(xxhash64({seed}, first, shards, q.place, '{salt}'), 11) + 0.5d) / 9007199254740992.0d)"
        step = _let("x", _let("h", "named_struct('pop', s.pop, 'own', q.blocks, 'draws', s.draws)", _drawn(chance("u"))), "named_struct('pop', s.pop - q.blocks, 'draws', s.draws - x, 'left', concat(s.left, array(x)))")
        pop = "aggregate(quota, 0L, (t, q) -> t + q.blocks)"
        start = f"named_struct('pop', {pop}, 'draws', cast(round(cast({pop} as double) * (shards div 2) / shards) as bigint), 'left', cast(array() as array<bigint>))"
        halved = nodes.withColumn("left", F.expr(f"if(shards > 1, aggregate(quota, {start}, (s, q) -> {step}, s -> s.left), transform(quota, q -> 0L))"))
        half = "named_struct('first', first + {0}, 'shards', {1}, 'quota', transform(quota, (q, i) -> named_struct('place', q.place, 'blocks', {2})))"
        sides = f"if(shards > 1, array({half.format(0, 'cast(shards div 2 as int)', 'left[i]')}, {half.format('cast(shards div 2 as int)', 'shards - cast(shards div 2 as int)', 'q.blocks - left[i]')}), array({half.format(0, 'shards', 'q.blocks')}))"
        nodes = stored(halved.select(F.explode(F.expr(sides)).alias("side")).select("side.*"))
    rows = nodes.select("first", F.explode("quota").alias("q")).select("first", "q.place", "q.blocks")
    listed = F.array_sort(F.collect_list(F.struct("first", "blocks")))
    grouped = rows.groupBy("place").agg(listed.alias("parts"))
    return grouped.select("place", F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i + 1), 0L, (t, x) -> t + x.blocks))").alias("ends"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, whole: bool = False) -> DataFrame:
    """id, source, size, source_size, target, taken, draws for each row of docs, and with `whole` that row as a struct, row.

    A draw is what one shard takes of a document in one epoch (repetition of the stream): epoch, block, shard, sort_key, which
    orders the draws of a shard, and words, from the document's first on. Documents are ordered by a hash of id and text.
    """
    # a key that is never null, so that the window and the join after it share one shuffle
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("turn"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    sized = stored(plain.drop("row"))
    bits = max(RANGES, sized.count() // RANGE_ROWS).bit_length() - 1
    ranged = lambda df: df.withColumn("range", F.shiftrightunsigned("turn", 64 - bits))
    ranges = stored(ranged(sized).groupBy("source", "range").agg(F.sum("size").alias("words")))
    sources = stored(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap).withColumn("blocks", F.ceil(F.col("quota") / block)))
    ends = shard_quotas(sources, shards, seed)
    known = sources.join(ends, "place")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(known.withColumnRenamed("source", "known"), F.col("source").eqNullSafe(F.col("known"))).drop("known", "words")
    starts = starts.withColumn("key_", named).withColumnRenamed("range", "range_").drop("source")
    within = Window.partitionBy("key", "range").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged(plain if whole else sized).withColumn("key", named).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, (F.col("key") == F.col("key_")) & (F.col("range") == F.col("range_")))
    placed = placed.withColumn("start", F.col("range_start") + F.col("inner"))
    draw = _let("r", permuted("b", "blocks", seed), f"named_struct('epoch', e, 'block', b, 'shard', size(filter(ends, x -> x <= r)), 'sort_key', xxhash64({seed}, turn, id, e), 'words', least(lo + size, quota) - lo)")
    run = _let("lo", "start + e * source_size", f"if(size > 0 and lo < quota, array({_let('b', f'lo div {block}', draw)}), array())")
    # blocks beyond the last end are no shard's
    drawn = placed.withColumn("draws", F.expr(f"filter(flatten(transform(sequence(0L, {cap - 1}L), e -> {run})), d -> d.shard < {shards})"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda t, d: t + d["words"])
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "draws", *(["row"] if whole else []))


def digest(draws: str) -> Column:
    """Draws as text: epoch:block:shard:words of each, comma-joined."""
    return F.array_join(F.transform(draws, lambda d: F.concat_ws(":", d["epoch"], d["block"], d["shard"], d["words"])), ",")


def materialised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The mix itself: a row of docs, with its columns, for each draw, shard after shard, shuffled within each shard.

    A draw of part of a document is its first words, joined by one space. Partitions hold consecutive ranges of (shard, sort
    key). Rows travel with their draws, so ids may be null or shared. `more` goes to `mix`.
    """
    drawn = mix(docs, id_col, text_col, source_col, whole=True, **more).select("row", "size", F.explode("draws").alias("draw"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row").getField(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") >= F.col("size"), F.col("row").getField(text_col)).otherwise(first)
    order = [F.col("draw.shard"), F.col("draw.sort_key")]
    placed = drawn.select("row", "draw", text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
