"""Passage deduplication by a sparse suffix array.

Minimisers say where to look: in each window of ``WINDOW`` hashes of ``GRAM`` words the smallest, so any two texts that
share ``WINDOW + GRAM - 1`` words have one at the same place of them. Only those whose gram occurs in several documents
count, and each stands for the suffixes that reach it within ``PASSAGE`` words: a common gram tells nothing of what precedes
it, and a passage may lie on either side. These suffixes are sorted by their first ``PASSAGE`` words, as a fingerprint, over
all tasks by ranges of fingerprint, key and place, so that a passage in very many documents is no task of its own.
Neighbours of one fingerprint and different documents match; matches that touch or overlap are extended left and right
into one passage. Grams with two places and with a million go the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, remove, table_path

GRAM = 8
WINDOW = 32
#: The least words of a repeated passage, by which suffixes are sorted.
PASSAGE = 50
#: Words of texts that are looked at together, one text at least.
PIECE_WORDS = 1 << 16

_draw = np.random.RandomState(97)
_FACTORS = _draw.randint(0, 1 << 62, GRAM, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pieces(texts: pa.Array, least: int):
    """(rows, bounds, hashes): the word hashes of texts of ``least`` words or more one behind another, some texts at a time;
    text ``i`` of ``rows`` has those from ``bounds[i]`` to ``bounds[i + 1]``."""
    rows, parts, size = [], [], 0
    for row, t in enumerate(texts):
        h = _word_hashes(t.as_buffer().to_pybytes())
        if len(h) >= least:
            rows.append(row)
            parts.append(h)
            size += len(h)
        if rows and (size >= PIECE_WORDS or row == len(texts) - 1):
            yield np.array(rows), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value of each ``width`` neighbours, the last of those that tie, by doubling."""
    at, have = np.arange(len(g), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        later = g[step:] <= g[:-step]
        g, at = np.where(later, g[step:], g[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return at


def minimisers(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes and places of the chosen suffixes of texts one behind another, in order; a text under a window keeps its
    smallest gram, one under a gram has none."""
    m = len(h) - GRAM + 1
    if m < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = np.zeros(m, np.uint64)
    for k in range(GRAM):
        g += h[k : k + m] * _FACTORS[k]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    g ^= g >> np.uint64(28)
    at = np.empty(0, np.int64)
    if m >= WINDOW:
        inside = np.ones(m - WINDOW + 1, bool)  # windows that no border of texts cuts
        cut_ = (bounds[1:-1, None] - np.arange(1, GRAM + WINDOW - 1)).ravel()
        inside[cut_[(cut_ >= 0) & (cut_ < len(inside))]] = False
        at = _least(g, WINDOW)[inside]
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    sizes = np.diff(bounds) - GRAM + 1
    short = [b + n - 1 - int(np.argmin(g[b : b + n][::-1])) for b, n in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True) if 0 < n < WINDOW]
    if short:
        at = np.sort(np.concatenate([at, short]))
    return g[at].view(np.int64), at


def _marks(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, bounds, h in _pieces(batch.column(1), GRAM):
            grams, at = minimisers(h, bounds)
            text = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[text]]), pa.array(grams), pa.array(at - bounds[text])], names=["id", "gram", "at"])


_powers = np.ones((2, 1), np.uint64)


def _rolls(n: int) -> np.ndarray:
    """Powers of ``_ROLL`` and of its inverse modulo 2 ** 64, ``n`` at least."""
    global _powers
    if _powers.shape[1] < n:
        table = np.array([[_ROLL], [pow(int(_ROLL), -1, 1 << 64)]], np.uint64).repeat(max(n, 2 * PIECE_WORDS), axis=1)
        table[:, 0] = 1
        _powers = np.cumprod(table, axis=1, dtype=np.uint64)
    return _powers


def _prints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the ``PASSAGE`` words from each place on: sums over word hashes times falling powers, each the
    difference of two sums from the start."""
    power, inverse = _rolls(len(h) + 1)
    before = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * inverse[: len(h)], out=before[1:])
    g = (before[at + PASSAGE] - before[at]) * power[at + PASSAGE - 1]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (g ^ (g >> np.uint64(29))).view(np.int64)


def _suffixes(batches):
    """Fingerprints of the first ``PASSAGE`` words, and first words, of the suffixes that reach a gram at one of the places
    within them."""
    for batch in batches:
        ids, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        offsets, flat = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False)
        for rows, bounds, h in _pieces(batch.column(1), PASSAGE):
            counts = offsets[rows + 1] - offsets[rows]
            text = np.repeat(np.arange(len(rows)), counts)
            p = bounds[text] + flat[np.repeat(offsets[rows] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))]
            first, last = np.maximum(bounds[text], p + GRAM - PASSAGE), np.minimum(p, bounds[text + 1] - PASSAGE)
            some = first <= last
            wanted = np.bincount(first[some], minlength=len(h) + 1) - np.bincount(last[some] + 1, minlength=len(h) + 1)
            at = np.flatnonzero(np.cumsum(wanted))
            text = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[text]]), pa.array(_prints(h, at)), pa.array(at - bounds[text])], names=["id", "print", "at"])


def _neighbours(batches):
    """(id, at, print, other, mark) of sorted suffixes: of those of one fingerprint and several documents each with the
    smallest of the others'. A task's first and last fingerprints may go on in other tasks: their rows come out without an
    ``other``, those of the two smallest keys marked."""
    held, first = None, True
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        ends = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1  # where a fingerprint ends and another begins
        done = int(ends[-1]) if len(ends) else 0
        held = [x[done:] for x in rows]
        if not done:
            continue
        begin = 0
        if first:
            begin, first = int(ends[0]), False
            yield _open([x[:begin] for x in rows])
        if begin < done:
            yield _matched(*(x[begin:done] for x in rows))
    if held is not None and len(held[0]):
        yield _open(held)


_FOUND = ["id", "at", "print", "other", "mark"]


def _open(rows: list[np.ndarray]) -> pa.RecordBatch:
    prints, ids, at = rows
    second = int(np.argmax(ids != ids[0])) if len(ids) and (ids != ids[0]).any() else 0
    mark = np.zeros(len(ids), bool)
    mark[[0, second]] = True
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(prints), pa.nulls(len(ids), pa.int64()), pa.array(mark)], names=_FOUND)


def _closed(lows: dict[int, tuple[int, int | None]]):
    """Give the rows of fingerprints that several tasks hold their ``other``; those of one document alone go."""
    prints = np.array(sorted(lows), dtype=np.int64)
    low = np.array([lows[p][0] for p in sorted(lows)], dtype=np.int64)
    some = np.array([lows[p][1] is not None for p in sorted(lows)], dtype=bool)
    second = np.array([lows[p][1] or 0 for p in sorted(lows)], dtype=np.int64)

    def run(batches):
        for b in batches:
            ids, at, own, other = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(), b.column(3)
            if other.null_count:
                null = other.is_null().to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(prints, own), max(0, len(prints) - 1))
                told = np.where(ids == low[place], second[place], low[place])
                other = pa.array(np.where(null, told, other.fill_null(0).to_numpy()))
                keep = pa.array(~null | some[place])
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), at.filter(keep), other.filter(keep)], names=["id", "at", "other"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), at, other], names=["id", "at", "other"])

    return run


def _matched(prints: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    n = len(prints)
    starts = np.concatenate([[0], np.flatnonzero(prints[1:] != prints[:-1]) + 1])
    ends = np.append(starts[1:], n)
    changes = np.append(np.flatnonzero((ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])) + 1, n)
    second = changes[np.searchsorted(changes, starts, side="right")]  # the run's first row of another document, or its end
    run = np.repeat(np.arange(len(starts)), ends - starts)
    low, next_ = ids[starts], ids[np.minimum(second, n - 1)]
    keep = np.repeat(second < ends, ends - starts)
    other = np.where(ids == low[run], next_[run], low[run])
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(at[keep]), pa.array(prints[keep]), pa.array(other[keep]), pa.array(np.zeros(int(keep.sum()), bool))], names=_FOUND)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of ``PASSAGE`` words or more that other documents hold too.

    Returns the key, ``first_word``, ``n_words`` (matches that touch or overlap are one passage) and ``other_id``, the
    smallest key of another document that holds ``PASSAGE`` consecutive words of the passage. Documents without one have no
    row; null and short texts and null keys have none. Rows that repeat a key are one document: a passage that only they share
    is none. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    written: list[str] = []

    def table(df: DataFrame, name: str) -> DataFrame:
        written.append(table_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    # written once, as words are hashed for them; a written table on one side also lets a gram with very many places be split
    # over tasks on the other
    marks = table(rows.mapInArrow(_marks, "id long, gram long, at long"), "marks")
    held = table(marks.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("gram"), "grams")
    chosen = table(marks.join(held, "gram").groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("places")), "places")
    remove(spark, written[0])
    suffixes = table(rows.join(chosen, "id").select("id", "text", "places").mapInArrow(_suffixes, "id long, print long, at long"), "suffixes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["print", "id", "at"]
    ranged = suffixes.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = table(ranged.mapInArrow(_neighbours, "id long, at long, print long, other long, mark boolean"), "found")
    for path in written[1:-1]:
        remove(spark, path)
    # two keys at most of each task's first and last fingerprint come to the driver
    lows: dict[int, tuple[int, int | None]] = {}
    for r in found.where("mark").select("print", "id").distinct().orderBy("print", "id").collect():
        at = lows.setdefault(r["print"], (r["id"], None))
        if at[1] is None and r["id"] != at[0]:
            lows[r["print"]] = (at[0], r["id"])
    spans = found.select("id", "at", "print", "other").mapInArrow(_closed(lows), "id long, at long, other long") if lows else found.select("id", "at", "other").where("other IS NOT NULL")
    before = F.lag("at").over(W.partitionBy("id").orderBy("at"))
    new = F.coalesce((F.col("at") > before + PASSAGE).cast("int"), F.lit(1))
    merged = spans.withColumn("new", new).withColumn("run", F.sum("new").over(W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("id", "run").agg(F.min("at").alias("first_word"), F.max("at").alias("last"), F.min("other").alias("other_id"))
    # rows of passages, far fewer than of suffixes, stay for the caller
    passages = cut(merged.select("id", "first_word", (F.col("last") + PASSAGE - F.col("first_word")).alias("n_words"), "other_id"))
    remove(spark, written[-1])
    return passages.withColumnRenamed("id", key)
