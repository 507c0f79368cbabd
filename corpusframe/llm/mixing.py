"""Mixing sources to target weights, with DataFrame functions only.

1. Each source's words are laid end to end and cut into blocks of a fixed length. Offsets are sums
   within about sqrt(rows) hashed groups plus sums over the groups' totals, so no task sees a source.
2. Source counts per output shard are drawn multinomially given the quotas: the places of all sources'
   quotas, laid end to end, are permuted pseudorandomly, and those that fall into a shard are counted by
   source. Counts in a shard are random, their sum over the shards is a source's quota exactly, so the
   words taken come near the target.
3. Sums of these counts over the shards before give each shard its slots of each source. A source's slots
   walk through pseudorandom permutations of its block indices, one for each epoch, so no block is taken
   more often than the epochs begun.
4. Blocks are joined with the slots by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, WORD, cut

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 32
SHARD_BLOCKS = 8192
SEED = 17
ROUNDS = 10
CHUNK = 4096


def permuted(df: DataFrame, index: str, size: str, *keys: str, seed: int = SEED) -> DataFrame:
    """Replace ``index`` in [0, size) by its image under a permutation keyed by ``keys``: in each round an
    index may swap places with a partner, as a hash of the larger one of both says."""
    of = F.col(size)

    def swapped(x: Column, i: Column) -> Column:
        keyed = [F.lit(seed), i, *map(F.col, keys)]
        partner = F.pmod(F.pmod(F.xxhash64(*keyed), of) - x + of, of)
        return F.when(F.xxhash64(*keyed, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return df.withColumn(index, F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.col(index), swapped))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, total) -> with s, weight and target, in closed form: in the order of cap to weight, a source is
    capped while its cap is at most its share of what the capped ones before it leave. One row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    t = totals.select("source", "total", place.alias("s"), weight.cast("double").alias("weight"), (F.col("total") * cap).alias("cap"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "s")
    everything = W.partitionBy()
    t = t.withColumn("all", F.sum("total").over(everything))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("all") - before) / rest)
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / free)
    return t.withColumn("target", target).select("source", "s", "total", "weight", "target")


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks and slots of each source: whole epochs, then as many blocks as the rest of the target fills."""
    q = sources.where("total > 0").withColumn("blocks", F.ceil(F.col("total") / block_words))
    epochs = F.floor(F.col("target") / F.col("total"))
    rest = F.round((F.col("target") - epochs * F.col("total")) / block_words).cast("long")
    return q.withColumn("slots", epochs * F.col("blocks") + rest).withColumn("base", F.sum("slots").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(W.partitionBy()))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """A few tiny rows that grow when they are exploded: over all tasks, and not to be taken for small below."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shard_counts(q: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, s, n): the slots of each source in each output shard of ``shard_blocks`` slots (the last one may
    be smaller), drawn without replacement from all quotas."""
    chunks = q.where("slots > 0").select("base", "slots", "all_slots", "s", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    places = _spread(chunks, "s", "chunk").select("s", "all_slots", F.explode(F.expr(f"sequence(base + chunk * {CHUNK}, base + least(slots, (chunk + 1) * {CHUNK}) - 1)")).alias("place"))
    drawn = permuted(places, "place", "all_slots", seed=seed + 1)
    return drawn.groupBy(F.expr(f"place div {shard_blocks}").alias("shard"), "s").agg(F.count("*").alias("n"))


def slots(q: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(s, slot, shard, epoch, block): every slot of the mix with its output shard and its source block."""
    counts = cut(shard_counts(q, shard_blocks, seed)).withColumn("g", F.expr(f"shard div {CHUNK}"))
    before = W.partitionBy("s").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    groups = counts.groupBy("s", "g").agg(F.sum("n").alias("held")).select("s", "g", (F.sum("held").over(before) - F.col("held")).alias("start"))
    within = W.partitionBy("s", "g").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    laid = counts.withColumn("end", F.sum("n").over(within)).join(groups, ["s", "g"])
    laid = laid.select("s", "shard", "n", (F.col("start") + F.col("end") - F.col("n")).alias("first")).join(q.select("s", "blocks"), "s")
    parts = laid.select("s", "shard", "blocks", "n", "first", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")).alias("chunk"))
    one = _spread(parts, "s", "shard", "chunk").select("s", "shard", "blocks", F.explode(F.expr(f"sequence(first + chunk * {CHUNK}, first + least(n, (chunk + 1) * {CHUNK}) - 1)")).alias("slot"))
    one = one.withColumn("epoch", F.expr("slot div blocks")).withColumn("block", F.expr("slot % blocks"))
    return permuted(one, "block", "blocks", "s", "epoch", seed=seed).select("s", "slot", "shard", "epoch", "block")


class Mix:
    """The tables of a mix. ``documents``: row, key, size, source size, target; ``pieces``: (s, block, row,
    lo, hi), the words [lo, hi) of a row that lie in a block; ``slots``: see ``slots()``; ``rows``, where
    ``whole`` asks for it: row, size and ``doc``, all columns of the document."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, whole: bool = False):
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if whole else []
        table = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("hash"), size.alias("size"), *kept))
        sized = table.drop("doc")
        self.rows = table.select("row", "size", "doc") if whole else None
        sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("total")), weights, cap))
        known = sources.withColumnRenamed("source", "source2")
        self.documents = sized.join(known, sized.source.eqNullSafe(known.source2)).drop("source2")
        groups = max(1, int(sized.count() ** 0.5))
        thin = self.documents.where("size > 0").select("s", "row", "key", "hash", "size", F.pmod(F.xxhash64("key", "hash"), F.lit(groups)).alias("g"))
        inner = W.partitionBy("s", "g").orderBy("key", "hash", "row").rowsBetween(W.unboundedPreceding, 0)
        outer = W.partitionBy("s").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
        starts = thin.groupBy("s", "g").agg(F.sum("size").alias("held")).select("s", "g", (F.sum("held").over(outer) - F.col("held")).alias("start"))
        laid = thin.withColumn("end", F.sum("size").over(inner)).join(starts, ["s", "g"]).withColumn("at", F.col("start") + F.col("end") - F.col("size"))
        block = F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})"))
        cuts = laid.select("s", "row", "at", "size", block.alias("block"))
        lo, hi = F.greatest(F.lit(0), F.col("block") * block_words - F.col("at")), F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at"))
        self.pieces = cuts.select("s", "block", "row", lo.alias("lo"), hi.alias("hi"))
        self.slots = slots(cut(quotas(sources, block_words)), shard_blocks, seed)

    def taken(self) -> DataFrame:
        """(row, lo, hi, times, first_shard, last_shard): the words of a row that the mix takes, how often, and
        the least and largest output shard that they go to."""
        times = self.slots.groupBy("s", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
        return self.pieces.join(times.hint("merge"), ["s", "block"]).select("row", "lo", "hi", "times", "first_shard", "last_shard")


def mixed_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """What a mix takes of each document: key, size, source_size, target, taken, and the least and largest
    output shard that hold some of its words (null where nothing is taken).

    Null, empty and blank texts have size 0 and none taken; null sources are one source, the last. Rows
    that repeat are documents of their own, also under null keys. Where all sizes are 0 all targets are 0;
    an empty table gives an empty one. Very long texts are cut into blocks like any other.
    """
    mix = Mix(docs, key, text, source, **options)
    words = mix.taken().groupBy("row").agg(F.sum(F.expr("(hi - lo) * times")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    return mix.documents.join(words.hint("merge"), "row", "left").select(F.col("key").alias(key), "size", F.col("total").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: a row for each time that words of a document are taken, with those words in
    their order (white space around them kept) as its text; a document wholly taken keeps its text. All
    columns stay, whatever their names.

    Documents of which nothing is taken have no row, so null, empty and blank texts have none. Rows that
    repeat are documents of their own; null keys and sources are values like others. An empty table gives
    an empty one. Very long texts are split into words once, however often they are taken.
    """
    mix = Mix(docs, key, text, source, whole=True, **options)
    parts = mix.taken().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("parts"))
    both = mix.rows.hint("merge").join(parts, "row")
    body = F.col("doc")[text]
    often = both.withColumn("most", F.expr("array_max(transform(parts, p -> p.times))"))
    # the least that every part is taken is how often the whole text is, if the parts are the whole
    least = F.expr("if(aggregate(parts, 0L, (n, p) -> n + p.hi - p.lo) = size, array_min(transform(parts, p -> p.times)), 0L)")
    split = F.regexp_extract_all(body, F.lit(rf"{SPACE}*{WORD}{SPACE}*"), F.lit(0))
    often = often.withColumn("whole", least).withColumn("pieces", F.when(F.col("most") > F.col("whole"), split))
    each = often.select("doc", "parts", "whole", "pieces", F.explode(F.expr("sequence(1L, most)")).alias("copy"))
    cut_out = F.expr("array_join(flatten(transform(filter(parts, p -> p.times >= copy), p -> slice(pieces, cast(p.lo + 1 AS int), cast(p.hi - p.lo AS int)))), '')")
    new = F.when(F.col("copy") <= F.col("whole"), body).otherwise(cut_out)
    return each.select(*(new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
