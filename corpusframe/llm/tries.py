"""Prefixes that conversations share, as level-order tries of prefix shards.

A node is a prefix of turns. Its key is the XOR of a 128-bit hash of each turn with its place, so keys of whole
conversations are running XORs, which Spark makes piece by piece for a conversation of any length. Equal keys
are combined before they are shuffled, so a first turn that a third of all conversations share is one row a task.

Nodes that one conversation alone holds, below another such node, need no trie: their figures follow from their
row. All others are shared, or the first node of one conversation alone, which is a leaf here. They are dealt into shards by
their ancestor at depth 1, 2, 4, ..., 2048: the first of these with at most ``SHARD_NODES`` nodes below. numpy
builds the shard's LOUDS bits (for each node in level order a one for each child, then a zero) and label arrays, and
adds members, leaves and saved code points from the last level to the first. What lies above all shards is merged
by Spark: figures of shard roots and upper nodes are placed on the path of their smallest member, summed from its
end to its start, and summed over members that pass a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import remove, table_path

#: A conversation's turns (2 to this power) that one window follows; longer ones are pieces, and their totals carry on.
PIECE_BITS = 12
#: Nodes below a shard's root, and about as many in a task.
SHARD_NODES = 200_000
LADDER = [1 << i for i in range(PIECE_BITS)]
#: How many turns of the first conversation of its hundred a conversation may start with.
HEAD = 5
NOTHING = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, piece: Column, order: list[Column], folded: dict[str, str], fold: Callable, join: Callable[[Column, Column], Column], reverse: bool = False, first: Callable[[DataFrame, W], DataFrame] | None = None, carry: str | None = None) -> DataFrame:
    """Running ``fold`` of columns along a key's rows, over pieces of them: ``folded`` names the results.

    Each piece is a window of its own; only keys with several pieces have rows in the table of totals that is
    joined to it. Also adds ``_top``, whether no piece follows. ``first`` adds columns within pieces; ``carry`` is such a
    column whose value at the end of a key's first piece holds for all pieces behind it.
    """
    df = df.withColumn("_piece", piece)
    within = W.partitionBy(key, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *(fold(F.col(c)).over(within).alias(out) for out, c in folded.items()))
    if first:
        local = first(local, within)
    last = [F.max_by(F.col(carry), F.size(carry)).alias("_carried")] if carry else []
    totals = local.groupBy(key, "_piece").agg(*(fold(F.col(c)).alias(f"_{out}") for out, c in folded.items()), *last)
    along = W.partitionBy(key).orderBy(F.col("_piece").desc() if reverse else F.col("_piece"))
    before = along.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(key, "_piece", F.count(F.lit(1)).over(W.partitionBy(key)).alias("_pieces"), F.lead("_piece").over(along).isNull().alias("_top"), *(fold(F.col(f"_{out}")).over(before).alias(f"_{out}") for out in folded), *([F.first("_carried").over(along).alias("_carried")] if carry else []))
    both = local.join(offsets.where("_pieces > 1").drop("_pieces"), [key, "_piece"], "left").withColumn("_top", F.coalesce("_top", F.lit(True)))
    for out in folded:
        both = both.withColumn(out, join(F.col(out), F.coalesce(f"_{out}", F.lit(0)))).drop(f"_{out}")
    if carry:
        both = both.withColumn(carry, F.when(F.size(carry) == 0, F.coalesce("_carried", carry)).otherwise(F.col(carry))).drop("_carried")
    return both.drop("_piece")


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered(conversations: DataFrame) -> DataFrame:
    """(c, pos, u1, u2, chars): each conversation's turns in order, two hashes and the length of each."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    piece = F.coalesce(F.shiftright("turn", PIECE_BITS), F.lit(-(1 << 62)).cast("long"))
    told = lambda df, w: df.select("c", "one", "_piece", "pos", *(F.xxhash64(F.lit(lane), "role", "text").alias(f"u{lane}") for lane in (1, 2)), F.length("text").cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(rows, "c", piece, order, {"pos": "one"}, F.sum, _plus, first=told).select("c", "pos", "u1", "u2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, depth, u1, u2, chars), (c, took, own)): rebuilt conversations, and what each took from where.

    A conversation c starts with the first h turns of conversation c - c % 100 (that of the same sign below
    zero), h = crc32(c) % 6, and goes on with its own behind its first h.
    """
    base, h = (F.col("c") - F.col("c") % 100).alias("base"), F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEAD + 1))
    heads = turns.where((F.col("c") % 100 == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("c").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "u1", "u2", "chars"))).alias("head"))
    own = turns.select("*", base, h.alias("h")).join(heads.select("base", F.size("head").alias("held")), "base", "left")
    took = F.least(F.col("h"), F.coalesce("held", F.lit(0))).cast("long")
    own_rows = own.where("pos > h").select("c", (F.col("pos") - F.col("h") + took).alias("depth"), "u1", "u2", "chars")
    convs = own.groupBy("c").agg(F.max(took).alias("took"), F.sum((F.col("pos") > F.col("h")).cast("long")).alias("own"))
    head_rows = convs.select("c", base, "took").where("took > 0").join(heads, "base").select("c", F.explode(F.slice("head", F.lit(1), F.col("took").cast("int"))).alias("t"))
    return own_rows.unionByName(head_rows.select("c", F.col("t.pos").alias("depth"), "t.u1", "t.u2", "t.chars")), convs


def paths(rows: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, chars, anc, ends): each prefix of each conversation, its key and its parent's,
    its ancestors and itself at the depths of ``LADDER``, and whether the conversation ends there."""
    rows = rows.withColumns({f"x{i}": F.xxhash64(f"u{i}", "depth") for i in (1, 2)})
    on_ladder = F.col("depth").isin(LADDER)

    def ladder(df: DataFrame, within) -> DataFrame:
        after = W.partitionBy("c", "_piece").orderBy("depth")
        return df.select("*", F.collect_list(F.when(on_ladder, F.struct("k1", "k2"))).over(within).alias("anc"), F.lead("depth").over(after).isNull().alias("_last"))

    keyed = running(rows, "c", F.shiftright("depth", PIECE_BITS), [F.col("depth")], {"k1": "x1", "k2": "x2"}, F.bit_xor, _xor, first=ladder, carry="anc")
    return keyed.select("c", "depth", "k1", "k2", _xor(F.col("k1"), F.col("x1")).alias("p1"), _xor(F.col("k2"), F.col("x2")).alias("p2"), "chars", "anc", (F.col("_last") & F.col("_top")).alias("ends"))


def nodes(path: DataFrame, n_convs: int, least: int) -> DataFrame:
    """Distinct prefixes with ``n`` members, smallest member, ``stops`` (members that end there) and their parent's
    members and smallest member; the root's are given."""
    each = path.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv_id"), F.sum(F.col("ends").cast("long")).alias("stops"), *(F.first(c).alias(c) for c in ("depth", "p1", "p2", "chars", "anc")))
    above = each.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n").alias("pn"), F.col("conv_id").alias("parent_conv_id"))
    top = each.where("depth = 1").select("*", F.lit(n_convs).cast("long").alias("pn"), F.lit(least).cast("long").alias("parent_conv_id"))
    return each.where("depth > 1").join(above, ["p1", "p2"]).unionByName(top)


def sharded(trie: DataFrame, limit: int) -> DataFrame:
    """Add r1, r2 and ``rung``: the key of the shard's root and its place on the ladder; null above all shards."""
    entry = lambda df: df.select("*", F.posexplode("anc").alias("rung", "a")).select("*", F.col("a.k1").alias("r1"), F.col("a.k2").alias("r2")).drop("a")
    heavy = entry(trie.select("anc")).groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("below")).where(F.col("below") > limit).select("r1", "r2", F.lit(True).alias("heavy"))
    each = entry(trie).join(heavy, ["r1", "r2"], "left")
    kept = [c for c in trie.columns if c not in ("k1", "k2", "anc")]
    root = F.min_by(F.when(F.col("heavy").isNull(), F.struct("r1", "r2", "rung")), F.when(F.col("heavy").isNull(), F.col("rung")))
    found = each.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in kept), root.alias("root"))
    return found.select("k1", "k2", *kept, "root.r1", "root.r2", "root.rung")


def places(k1: np.ndarray, k2: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Where each wanted pair stands among the keys, -1 if nowhere."""
    a, b, n = np.concatenate([k1, w1]), np.concatenate([k2, w2]), len(k1)
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    group = np.empty(len(a), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    place = np.full(len(a), -1, dtype=np.int64)
    place[group[:n]] = np.arange(n)
    return place[group[n:]]


class Louds:
    """A forest in level order below a root without a turn, node 0.

    ``bits`` holds a one for each child and a zero behind them, node after node; ``labels`` the hashes of the
    edges. The parent of node i is the number of zeros before the i-th one, the degree the length of a run of ones.
    """

    def __init__(self, parent: np.ndarray, level: np.ndarray, label: np.ndarray):
        """``parent`` is a row or -1, ``level`` the distance from a root, ``label`` orders and names siblings."""
        n = len(parent)
        number = np.zeros(n + 1, dtype=np.int64)  # the last stands for parent -1, node 0
        self.rows, self.starts, at = np.empty(n, dtype=np.int64), [1], 1
        by_level = np.argsort(level, kind="stable")
        ends = np.cumsum(np.bincount(level)) if n else []
        begin = 0
        for end in ends:
            here = by_level[begin:end]
            here = here[np.lexsort((label[here], number[parent[here]]))]
            number[here] = np.arange(at, at + len(here))
            self.rows[at - 1 : at - 1 + len(here)] = here
            begin, at = end, at + len(here)
            self.starts.append(at)
        degree = np.bincount(number[parent], minlength=n + 1) if n else np.zeros(1, dtype=np.int64)
        self.bits = np.ones(2 * n + 1, dtype=np.uint8)
        self.bits[np.cumsum(degree + 1) - 1] = 0
        self.labels = label[self.rows]

    def parents(self) -> np.ndarray:
        """Of nodes 1 and on."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(self.bits == 0), prepend=-1) - 1

    def levels(self) -> Iterator[slice]:
        """The nodes of each level, the last level first."""
        for s, e in reversed(list(zip(self.starts, self.starts[1:], strict=False))):
            yield slice(s, e)


def rolled(trie: Louds, stops: np.ndarray, member: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """(members, smallest member, leaves, saved) of nodes 0 and on, from what stands at rows."""
    n = len(trie.rows) + 1
    members, least, saved = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    leaves, own = (trie.degrees() == 0).astype(np.int64), np.zeros(n, dtype=np.int64)
    members[1:], least[1:], own[1:] = stops[trie.rows], member[trie.rows], chars[trie.rows]
    up = np.concatenate([[0], trie.parents()]).astype(np.int64)
    for at in trie.levels():
        saved[at] += (members[at] - 1) * own[at]
        np.add.at(members, up[at], members[at])
        np.add.at(leaves, up[at], leaves[at])
        np.add.at(saved, up[at], saved[at])
        np.minimum.at(least, up[at], least[at])
    return members, least, leaves, saved


_OUT = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, stops long, root boolean"


def _shards(table: pa.Table) -> pa.Table:
    """Nodes of several shards with their figures; a node of one member that goes on has a child beyond the trie."""
    col = {c: table.column(c).to_numpy() for c in ("k1", "k2", "p1", "p2", "depth", "n", "stops", "conv_id", "least_stop", "chars", "rung", "parent_conv_id")}
    alone = col["n"] == 1
    parent = places(col["k1"], col["k2"], col["p1"], col["p2"])
    trie = Louds(parent, col["depth"] - (1 << col["rung"].astype(np.int64)), col["k1"] ^ col["p1"])
    members, least, leaves, saved = rolled(trie, np.where(alone, 1, col["stops"]), col["least_stop"], col["chars"])
    up, rows = trie.parents(), trie.rows
    inner = up > 0
    out = {c: col[c][rows] for c in ("k1", "k2", "p1", "p2")}
    out |= {"conv_id": least[1:], "depth": col["depth"][rows], "parent_conv_id": np.where(inner, least[up], col["parent_conv_id"][rows]), "n_convs": members[1:]}
    out |= {"n_children": trie.degrees()[1:] + (alone & (col["stops"] == 0))[rows], "n_leaves": leaves[1:], "saved_tokens": saved[1:], "stops": col["stops"][rows], "root": ~inner}
    return pa.table(out)


def ends(path: DataFrame, turnless: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the ids of conversations that end at a node, in order.

    Ids are joined in blocks of 4,096 before the shuffle of a node's blocks to one task, which feeds them to the
    digest one after another: SHA-256 is a chain over its input, so a node is one task, but holds one block.
    """
    rows = path.where("ends").select("k1", "k2", "c").unionByName(turnless.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "c"))
    joined = F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",")
    blocks = rows.groupBy("k1", "k2", F.shiftright("c", 12).alias("block")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for b in batches:
            for k1, k2, ids in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if key == (k1, k2):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield _digests(done)
            done = []
        yield _digests([(*key, state.hexdigest())] if key is not None else [])

    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["k1", "k2", "ends_sha256"])


def merged(path: DataFrame, roots: DataFrame, upper: DataFrame) -> DataFrame:
    """Figures of the nodes above all shards: (k1, k2, n_leaves, saved_tokens) without the root of all.

    Shard roots and upper nodes are placed on the path of their smallest member and summed from its end on, in
    pieces; then sums are added over the members that stand for them. As many rows as those members have prefixes.
    """
    placed = roots.select(F.col("conv_id").alias("c"), "depth", "n_leaves", "saved_tokens").unionByName(upper.select(F.col("conv_id").alias("c"), "depth", F.col("leaf").alias("n_leaves"), F.col("own").alias("saved_tokens")))
    reach = placed.groupBy("c").agg(F.max("depth").alias("to"))
    along = path.select("c", "depth", "k1", "k2").join(reach, "c").where("depth <= to").join(placed, ["c", "depth"], "left")
    along = along.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_leaves", "saved_tokens")})
    summed = running(along, "c", F.shiftright("depth", PIECE_BITS), [F.col("depth").desc()], {"_leaves": "n_leaves", "_saved": "saved_tokens"}, F.sum, _plus, reverse=True)
    return summed.groupBy("k1", "k2").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, nulls first, equal ones by role and text; rows that repeat are turns of their
    own. Null roles and texts are empty. Rows without a conversation's id belong to none. A conversation that
    nothing is left of ends at the root; a table without conversations has no node, not even a root. Texts and
    conversations of any length are whole. Other columns are not read.
    """
    spark = conversations.sparkSession
    written: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        written.append(table_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.parquet(written[-1])

    rows, convs = rebuilt(write(numbered(conversations), "turns"))
    convs, path = write(convs, "conversations"), write(paths(rows), "paths")
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum(F.when(F.col("took") + F.col("own") == 0, 1).otherwise(0)).alias("stops")).first()
    node = write(nodes(path, total.n, total.least if total.n else 0), "nodes")
    alone = (F.col("n") == 1) & (F.col("pn") == 1)
    ended = F.when(F.col("stops") == 1, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
    tails = node.where(alone).select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), (1 - F.col("stops")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"))

    stopping = path.where("ends").groupBy("k1", "k2").agg(F.min("c").alias("least_stop"))
    trie = node.where(~alone).join(stopping, ["k1", "k2"], "left")
    trie = trie.withColumn("least_stop", F.when(F.col("n") == 1, F.col("conv_id")).otherwise(F.coalesce("least_stop", F.lit((1 << 63) - 1))))
    trie = write(sharded(trie, shard_nodes), "trie")
    bins = max(1, -(-trie.where("r1 IS NOT NULL").count() // shard_nodes))
    below = trie.where("r1 IS NOT NULL").withColumn("_bin", F.pmod(F.xxhash64("r1", "r2"), F.lit(bins)))
    below = write(below.groupBy("_bin").applyInArrow(_shards, _OUT), "shards")

    children = below.where("root").select("p1", "p2").unionAll(trie.where("r1 IS NULL").select("p1", "p2")).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("held"))
    upper = trie.where("r1 IS NULL").join(children, ["k1", "k2"], "left")
    upper = upper.withColumn("n_children", F.when(F.col("n") == 1, 1 - F.col("stops")).otherwise(F.coalesce("held", F.lit(0).cast("long"))))
    upper = upper.select("k1", "k2", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "stops", F.coalesce("held", F.lit(0)).alias("held"), ((F.col("n") - 1) * F.col("chars")).alias("own"))
    upper = upper.withColumn("leaf", (F.col("held") == 0).cast("long"))
    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = upper.join(merged(path, below.where("root"), upper), ["k1", "k2"]).select(columns)
    figures = below.where("root").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).crossJoin(upper.agg(F.sum("leaf").alias("ul"), F.sum("own").alias("us"))).first()
    first_turns = node.where("depth = 1").count()
    top = spark.createDataFrame([(0, 0, total.least, 0, None, total.n, first_turns, max(1, (figures.l or 0) + (figures.ul or 0)), (figures.s or 0) + (figures.us or 0))] if total.n else [], ", ".join(f"{c} long" for c in columns))
    shared = below.select(columns).unionByName(above).unionByName(top)
    shared = shared.join(ends(path, convs.where("took + own = 0").select("c")), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    kept = table_path(spark, "tries")
    shared.drop("k1", "k2").unionByName(tails).write.parquet(kept)
    for path_ in written:
        remove(spark, path_)
    return spark.read.parquet(kept)
