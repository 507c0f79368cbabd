"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where it falls under a threshold, so chunks depend on
the last 16 bytes alone and find each other again behind insertions. A piece that stays long is cut where the
hash is the least around. Chunks with equal digests in different documents are candidates; spans of
neighbouring candidates that are just long enough to be no chance are compared as wholes, so that a passage is
one that some other document holds in one piece.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Mean and largest bytes of a chunk, and the least bytes of a repeated passage.
MEAN = 32
LONGEST = 512
_SIZE_BITS = 12
PASSAGE = 128
#: Means of a chunk beyond which a piece without a cut gets some, and the bytes that these look at on either side.
GAP = 3
REACH = 40

_draw = np.random.RandomState(41)
_GEAR = _draw.randint(0, 1 << 16, 256).astype(np.uint16)
_VALUES = _draw.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(3)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the digest's base and its inverse, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))


_powers = _Powers()


def chunk(data: bytes, mean: int = MEAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts and sizes in bytes of the chunks of a text; none for an empty one."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8):  # doubles the window up to 16 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint16(k)) if k < n else h[k:]
    whole = np.ones(n, bool)
    whole[:-1] = (b[1:] & 0xC0) != 0x80  # no cut inside a character
    ends = np.flatnonzero((h < (1 << 16) // mean) & whole) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate(([0], ends[:-1]))
    if n > 2 * REACH and (ends - starts).max() > GAP * mean:
        ends = np.union1d(ends, np.array(_least(h, whole, ends, ends - starts, mean), np.int64))
        starts = np.concatenate(([0], ends[:-1]))
    if (ends - starts).max() > LONGEST:
        parts = []
        for s, e in zip(starts, ends, strict=True):
            for cut in range(s + LONGEST, e, LONGEST):
                while cut < e and not whole[cut - 1]:
                    cut += 1
                if cut < e:
                    parts.append(cut)
            parts.append(e)
        ends = np.array(parts)
        starts = np.concatenate(([0], ends[:-1]))
    _powers.to(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[b] * _powers.up[:n], dtype=np.uint64)))
    d = (sums[ends] - sums[starts]) * _powers.down[starts]
    d = (d ^ (d >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (d ^ (d >> np.uint64(29))).view(np.int64), starts.astype(np.int64), (ends - starts).astype(np.int64)


def _least(h: np.ndarray, whole: np.ndarray, ends: np.ndarray, sizes: np.ndarray, mean: int) -> list[int]:
    """Cuts of pieces without any: behind hashes that are the least within ``REACH`` bytes on either side. A word over
    and over has one in every period, wherever it begins and ends; of these those half a mean apart are taken."""
    low, have = h, 1
    while have < 2 * REACH + 1:
        step = min(have, 2 * REACH + 1 - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    places = np.flatnonzero((h[REACH : len(h) - REACH] == low) & whole[REACH : len(h) - REACH]) + REACH
    cuts, last = [], 0
    for p in places[sizes[np.searchsorted(ends, places, "right")] > GAP * mean].tolist():
        if p + 1 - last >= mean // 2:
            cuts.append(p + 1)
            last = p + 1
    return cuts


def _rows(mean: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            got = [chunk(t.as_py().encode(), mean) for t in batch.column(1)]
            counts = [len(g[0]) for g in got]
            if sum(counts):
                digests, starts, sizes = (np.concatenate([g[i] for g in got]) for i in range(3))
                columns = [np.repeat(ids, counts), digests, starts << _SIZE_BITS | sizes]  # place and size in one number
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "digest", "place"])

    return run


def _spans(passage: int):
    """Of repeated chunks, sorted by document and place: from each chunk on, and up to each chunk, the
    shortest span of neighbouring chunks with ``passage`` bytes. Any longer piece is a union of such spans."""

    def emit(ids: np.ndarray, digests: np.ndarray, at: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        n, ends = len(ids), np.cumsum(sizes)
        starts = ends - sizes
        last = np.minimum(np.searchsorted(ends, starts + passage), n - 1)  # the chunk that completes the span from each chunk on
        first = np.maximum(np.searchsorted(starts, ends - passage, "right") - 1, 0)  # and the one that a span up to each starts with
        i = np.flatnonzero((runs[last] == runs) & (ends[last] - starts >= passage))
        j = np.flatnonzero((runs[first] == runs) & (ends - starts[first] >= passage))
        both = np.unique(np.concatenate((i * n + last[i], first[j] * n + j)))
        x, y = both // n, both % n
        key = np.zeros(len(both), np.uint64)
        for k in range(int((y - x).max()) + 1 if len(both) else 0):
            new = (key ^ digests[np.minimum(x + k, n - 1)].view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            key = np.where(x + k <= y, new ^ (new >> np.uint64(31)), key)
        nth = np.arange(n) - np.searchsorted(runs, runs)
        columns = [ids[x], key.view(np.int64), at[x], ends[y] - starts[x], nth[x], y - x + 1]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "span", "start", "size", "nth", "chunks"])

    def run(batches):
        left = [np.empty(0, np.int64)] * 4
        for batch in batches:
            rows = [np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip(left, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            fresh = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in rows], axis=0)))
            ids, digests, at, sizes = rows = [c[fresh] for c in rows]
            runs = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + sizes[:-1]))))
            open_at = int(np.searchsorted(runs, runs[-1]))  # the last run may go on
            if open_at:
                yield emit(*(c[:open_at] for c in (*rows, runs)))
            left = [c[open_at:] for c in rows]
        if len(left[0]):
            yield emit(*left, np.zeros(len(left[0]), np.int64))

    return run


def _pieces(batches):
    """Spans, sorted by document and start, to pieces: each byte goes with the smallest key that holds a span over it."""

    def split(spans: list[tuple], out: list[tuple]) -> None:
        nth = {s[1]: s[4] for s in spans} | {s[2]: s[4] + s[5] for s in spans}
        bounds, waiting, pieces, k = sorted(nth), [], [], 0
        for x, y in zip(bounds, bounds[1:], strict=False):
            while k < len(spans) and spans[k][1] <= x:
                heapq.heappush(waiting, (spans[k][3], spans[k][2]))
                k += 1
            while waiting[0][1] <= x:
                heapq.heappop(waiting)
            if pieces and pieces[-1][2] == waiting[0][0]:
                pieces[-1][1] = y
            else:
                pieces.append([x, y, waiting[0][0]])
        out.extend((spans[0][0], x, y - x, nth[y] - nth[x], low) for x, y, low in pieces)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "size", "chunks", "first_id"])

    held: list[tuple] = []  # spans of one document that overlap or touch: id, start, end, low, nth, chunks
    end = 0
    for batch in batches:
        out: list[tuple] = []
        for i, start, size, low, nth, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (i != held[-1][0] or start > end):
                split(held, out)
                held = []
            end = max(end, start + size) if held else start + size
            held.append((i, start, start + size, low, nth, chunks))
        yield batch_of(out)
    out = []
    if held:
        split(held, out)
    yield batch_of(out)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", mean: int = MEAN, passage: int = PASSAGE) -> DataFrame:
    """Passages of ``passage`` bytes or more that some other document holds in one piece, by whole chunks.

    Returns the key, ``start`` and ``size`` in bytes, ``chunks``, ``first_id`` (the smallest key that holds a passage
    over all of this piece) and ``keep`` (that is the document itself). Where the smallest holder changes a
    new piece starts, so pieces may be shorter than ``passage``. Documents without such a passage have no
    row; null and empty texts and null keys have none. Rows that repeat a key are one document.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(_rows(mean), "id long, digest long, place long")
    held = lambda df, by: df.groupBy(by).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(by, "low")
    # a written table on one side lets a digest with very many places be split over tasks on the other
    again = chunks.join(cut(held(chunks, "digest").select("digest")), "digest").select("id", "digest", F.shiftright("place", _SIZE_BITS).alias("at"), F.col("place").bitwiseAND(F.lit((1 << _SIZE_BITS) - 1)).alias("size"))
    spans = again.repartition("id").sortWithinPartitions("id", "at", "size", "digest").mapInArrow(_spans(passage), "id long, span long, start long, size long, nth long, chunks long")
    found = spans.join(held(spans, "span"), "span").select("id", "start", "size", "low", "nth", "chunks")
    pieces = found.repartition("id").sortWithinPartitions("id", "start", "size", "low").mapInArrow(_pieces, "id long, start long, size long, chunks long, first_id long")
    return pieces.select(F.col("id").alias(key), "start", "size", "chunks", "first_id", (F.col("first_id") == F.col("id")).alias("keep"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the pieces that a document with a smaller key holds; all columns stay.

    Null texts and keys, empty texts and documents without such a piece stay as they are. Rows that repeat a
    key are one document where pieces are looked for, so each loses the pieces that any of them is to lose.
    """
    drop = repeated_passages(docs, key, text, **options).where("NOT keep").groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("drop"))
    names = docs.columns
    at = names.index(text)
    whole = docs.select(F.col(key).cast("long").alias("_key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))

    def run(batches):
        for batch in batches:
            new = []
            for t, d in zip(batch.column(at), batch.column(len(names)), strict=True):
                t, d = t.as_py(), d.as_py()
                if t is not None and d:
                    data, left, end = t.encode(), [], 0
                    for x in d:
                        left.append(data[end : max(end, x["start"])])
                        end = max(end, x["start"] + x["size"])
                    t = b"".join([*left, data[end:]]).decode("utf-8", "ignore")
                new.append(t)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = whole.join(drop, F.col("_key") == F.col("_k"), "left").select(*(F.col("doc")[c].alias(f"c{i}") for i, c in enumerate(names)), "drop")
    return joined.mapInArrow(run, docs.schema)
