"""Near-duplicate removal: a multi-index Hamming join over b-bit MinHash signatures.

Each set of shingles gets a signature of ``CHUNKS * WIDTH`` symbols of 16 bits. Two signatures that
differ in at most ``2 * CHUNKS - 1`` symbols have, by pigeonhole, a chunk with at most one error, so
every chunk is indexed once for each symbol that may be wrong, with that symbol left out. All pairs
within that distance meet in a bucket.

Buckets never emit all their pairs. Each member is first compared, on the full sets, with the smallest
member alone; the links found give components. Only buckets of three or more that still hold several
components are left, and their members go through an exact prefix-filter join on the full sets, which
any two sets of the wanted similarity pass. So no bucket is capped and no link that shares a bucket is
lost. Documents with equal sets are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, forget

SHINGLE = 5
PERCENT = 85
CHUNKS = 8
WIDTH = 5
#: Candidates up to this number are sent to every executor as ids (16 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000

_draw = np.random.RandomState(20_240_917)
_big = lambda *shape: _draw.randint(0, 1 << 62, shape, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_WORD_FACTORS = _big(SHINGLE)
_SHORT = _big(SHINGLE)
_FACTORS = _draw.randint(0, 1 << 31, CHUNKS * WIDTH, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _draw.randint(0, 1 << 32, CHUNKS * WIDTH, dtype=np.int64).astype(np.uint32)
_SALTS = _big(CHUNKS, WIDTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words than a shingle make one."""
    words = (text or "").encode().lower().split()  # bytes.lower() and split() know ASCII alone
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        return _mix((h * _WORD_FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) ^ _SHORT[n])
    total = h[: n - SHINGLE + 1] * _WORD_FACTORS[0]
    for k in range(1, SHINGLE):
        total = total + h[k : n - SHINGLE + 1 + k] * _WORD_FACTORS[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the minimum under each of the permutations."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        part = low[i : i + 4096]
        np.minimum(least, (_FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]).min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint64)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each chunk and each of its symbols that may be in error."""
    chunks = sig.reshape(CHUNKS, WIDTH)
    keys = np.empty((CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        packed = np.zeros(CHUNKS, np.uint64)
        for k in range(WIDTH):
            if k != left_out:
                packed = (packed << np.uint64(16)) | chunks[:, k]
        keys[:, left_out] = _mix(packed ^ _SALTS[:, left_out])
    return keys.reshape(-1).view(np.int64)


def _signed(batches):
    forget()
    for batch in batches:
        sets, sizes, keys = [], [], []
        for t in batch.column(1):
            h = shingle_hashes(t.as_py())
            sizes.append(len(h))
            sets.append(xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None)
            keys.append(index_keys(signature(h)) if len(h) else np.empty(0, np.int64))
        offsets = np.zeros(len(keys) + 1, np.int32)
        np.cumsum([len(k) for k in keys], out=offsets[1:])
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.string()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["id", "set_id", "n", "keys"],
        )


def _sets(batches):
    forget()
    for batch in batches:
        hashes = [shingle_hashes(t.as_py()).view(np.int64) for t in batch.column(1)]
        offsets = np.zeros(len(hashes) + 1, np.int32)
        np.cumsum([len(h) for h in hashes], out=offsets[1:])
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "hashes"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, comp), comp the smallest id reachable: smallest label of the neighbours,
    then of the label itself, until nothing changes."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        step = cut(step.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        changed = step.where("old <> comp").limit(1).count()
        labels = step.select("id", "comp")
        if not changed:
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The sets of ``b`` come first, so that the set of an ``a`` with very
    many partners is sent once and not with each of them; Spark splits such an ``a`` over tasks."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"h{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("shared"))
    return shared.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _prefix_pairs(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that can be similar enough: both sets, rarest shingles first, must
    share one among the first ``n - ceil(percent/100 n) + 1``, early enough for the rest to suffice."""
    tokens = sets.join(comps, "id").select("id", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held"))
    place = F.row_number().over(W.partitionBy("id").orderBy("held", "token"))
    ranked = tokens.join(held, "token").withColumn("place", place)
    first = cut(ranked.where(F.expr(f"place <= n - ceil({percent} * n / 100.0D) + 1 AND held > 1")).select("token", "id", "comp", "n", "place"))
    other = first.select("token", *(F.col(c).alias(f"{c}2") for c in ("id", "comp", "n", "place")))
    within = f"""id < id2 AND comp <> comp2 AND 100 * least(n, n2) >= {percent} * greatest(n, n2)
        AND 100 * (1 + least(n - place, n2 - place2)) >= {percent} * (n + n2 - 1 - least(n - place, n2 - place2))"""
    return first.join(other, "token").where(within).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * shared >= percent * union``.

    Returns the key, ``n_shingles`` long, ``component_id`` (the smallest key reachable) and ``kept``
    boolean. Null, empty and blank texts have no shingles, link with nothing and are kept, and so do rows with
    a null key, whose component is that of their set. Equal sets are linked. Rows that repeat a key are one
    document: of different texts the one with the smallest hash stands for it in comparisons, and equal sets of
    any are linked. Whole texts are compared, however long. An empty table gives an empty one.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(source.mapInArrow(_signed, "id long, set_id string, n long, keys array<long>"))
    # written, so that a set with very many documents can be split over tasks where it is joined
    classes = cut(signed.where("set_id is not null").groupBy("set_id").agg(F.min("id").alias("rep")))
    reps = signed.join(classes, (signed.set_id == classes.set_id) & (signed.id == classes.rep), "left_semi")
    keys = reps.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("held")).where("held > 1")
    members = cut(keys.join(shared, "key").select("key", "id", "first", "held"))
    stars = cut(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    wanted = cut(stars.select("a").union(stars.select("b")).toDF("id").distinct())
    few = wanted.count() <= BROADCAST_IDS
    sets = cut(source.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).mapInArrow(_sets, "id long, hashes array<long>"))
    links = cut(_confirmed(stars, sets, percent))
    found = components(links)
    split = members.where("held > 2").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = split.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rest = cut(members.join(split, "key", "left_semi").select("id").distinct())
    if rest.limit(1).count():
        comps = rest.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        more = cut(_confirmed(cut(_prefix_pairs(sets, comps, percent)), sets, percent))
        if more.limit(1).count():
            found = components(links.union(more))
    result = signed.join(classes, "set_id", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    result = result.join(found.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    component = F.coalesce("comp", "rep")
    return result.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
