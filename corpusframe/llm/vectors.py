"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds, in whole numbers.

A component x counts as floor(1024 x); a vector is cut into four equal parts, each coded by the nearest of
at most 256 entries of its position's codebook. A part keeps one upper bound of the distance to its entry and
one lower bound of that to the second nearest. Entries that move loosen both by how far they moved; only
where the upper one is not strictly below the lower one, or below half the way to the entry's own nearest
neighbour, is the distance taken anew, and only where that is not enough are all entries scanned. Strictly
below means that no other entry is as near, so the lower of two equally near entries is found by the scan.

Each round writes the vectors with their codes and bounds to the shared folder and reads them again, so that
a lost executor repeats a task of one round; the table of the round before goes then. Only sums of each entry
and component come to the driver, as many numbers as the codebooks have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, table_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components are held within these bounds, so that a sum of squares of 8,192 of them stays within a long.
LARGEST = 1 << 24
#: Whole numbers below this are exact as doubles, and so are products of matrices that stay below it.
_EXACT = 1 << 53
_STATE = "vec_id long, label string, x array<int>, code array<int>, upper array<double>, lower array<double>"


def kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, label, x): components as whole numbers, rows with a null or non-finite one left out."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return vectors.where(v.isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), named.alias("label"), whole.alias("x"))


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """(part, entry, component) of the smallest keys' vectors; of rows that repeat a key the least vector counts."""
    ids = rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).agg(F.max("vec_id").alias("last")).first()
    seeds = rows.where(F.col("vec_id") <= ids["last"]).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect() if ids["last"] is not None else []
    books = np.zeros((PARTS, len(seeds), width), dtype=np.int64)
    for i, r in enumerate(seeds):
        books[:, i] = _parts(np.pad(np.asarray(r["x"], dtype=np.int64), (0, PARTS * width - len(r["x"])))[None])[0]
    return books


def _parts(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), PARTS, x.shape[1] // PARTS)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], axis=1)


def _above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d * (1 + 1e-12), np.inf)


def _below(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d * (1 - 1e-12), -np.inf)


class Moves:
    """How far entries moved between two rounds, and half the way to their nearest neighbours, for bounds."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.far = _above(np.sqrt(((new - old) ** 2).sum(2).astype(np.float64)))
        places = np.argsort(self.far, axis=1)
        self.most, self.next = places[:, -1], np.take_along_axis(self.far, places[:, -2:-1] if new.shape[1] > 1 else places[:, -1:], 1)[:, 0]
        self.half = np.full(self.far.shape, np.inf)
        for p in range(len(new)):
            for e in range(new.shape[1] if new.shape[1] > 1 else 0):
                d = ((new[p] - new[p, e]) ** 2).sum(1)
                d[e] = np.iinfo(np.int64).max
                self.half[p, e] = _below(np.sqrt(float(d.min()))) / 2

    def loosened(self, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of part ``p`` once entries have moved; the lower one includes the half way."""
        others = np.where(code == self.most[p], self.next[p], self.far[p, self.most[p]])
        return _above(upper + self.far[p, code]), _below(lower - others)


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lowest of equals, with bounds from a full scan."""
    d = _squares(x, book)
    code = d.argmin(1)
    at = np.arange(len(x))
    upper = _above(np.sqrt(d[at, code].astype(np.float64)))
    d[at, code] = np.iinfo(np.int64).max
    return code, upper, _below(np.sqrt(d.min(1).astype(np.float64))) if book.shape[0] > 1 else np.full(len(x), np.inf)


def reassigned(x: np.ndarray, book: np.ndarray, moves: Moves, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``assigned``, by bounds where they hold strictly; also the number of rows that were scanned."""
    code, (upper, lower) = code.copy(), moves.loosened(p, code, upper, lower)
    bound = np.maximum(lower, moves.half[p, code])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = _above(np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(1).astype(np.float64)))
    scan = open_[~(upper[open_] < bound[open_])]
    if len(scan):
        code[scan], upper[scan], lower[scan] = assigned(x[scan], book)
    return code, upper, lower, len(scan)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column as a matrix; shorter lists are filled with zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.diff(column.offsets.to_numpy())
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), dtype=kind)
    out[np.arange(width) < n[:, None]] = flat
    return out


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))


def _round(books: np.ndarray, before: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One assignment of every row to ``books``; ``before`` are those that the rows' bounds are of."""
    width, moves = books.shape[2], None if before is None else Moves(before, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(_matrix(b.column("x"), PARTS * width, np.int64))
            code, upper, lower = (np.zeros((len(x), PARTS), dtype=k) for k in (np.int64, np.float64, np.float64))
            if moves is not None:
                code, upper, lower = (_matrix(b.column(c), PARTS, k) for c, k in (("code", np.int64), ("upper", np.float64), ("lower", np.float64)))
            for p in range(PARTS):
                if moves is None:
                    code[:, p], upper[:, p], lower[:, p] = assigned(x[:, p], books[p])
                else:
                    code[:, p], upper[:, p], lower[:, p], _ = reassigned(x[:, p], books[p], moves, p, code[:, p], upper[:, p], lower[:, p])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _lists(code.astype(np.int32)), _lists(upper), _lists(lower)], ["vec_id", "label", "x", "code", "upper", "lower"])

    return run


def _totals(width: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of a task's rows for each part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, entries, width), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)
        for b in batches:
            x, code = _parts(_matrix(b.column("x"), PARTS * width, np.int64)), _matrix(b.column("code"), PARTS, np.int64)
            for p in range(PARTS):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), _lists(sums[p, e]) if len(p) else pa.array([], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the floored means of the rows that are assigned to each entry; unused entries stay."""
    parts = state.select("x", "code").mapInArrow(_totals(books.shape[2], books.shape[1]), "part int, entry int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    each = parts.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(exact("n").alias("n"), exact("v").alias("v"))
    new = books.copy()
    for r in each.collect():
        new[r["part"], r["entry"], r["at"]] = int(r["v"]) // int(r["n"])
    return new


def _finals(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes in hexadecimal digits and squared distances to the coded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code = _parts(_matrix(b.column("x"), PARTS * books.shape[2], np.int64)), _matrix(b.column("code"), PARTS, np.int64)
            error = ((x - books[np.arange(PARTS), code]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(["".join(f"{c:02x}" for c in r) for r in code.tolist()], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of all vectors.

    Rows whose vector is null or holds a null or non-finite component have no code and are left out. Vectors
    of another length count as filled with zeros to the largest length, rounded up to a multiple of four; an
    empty vector is all zeros. Components beyond +-16,384 count as that much. Fewer than 256 different keys make
    smaller codebooks; where all keys are null, one entry of zeros codes all rows. Rows that repeat are coded
    each. A row with a null key is coded but starts no entry. An empty table gives an empty one. Other columns
    are not read.
    """
    spark, rows = vectors.sparkSession, kept(vectors, key, vector, label)
    longest = rows.agg(F.max(F.size("x")).alias("n")).first()["n"]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((PARTS, 0, 1), dtype=np.int64)
    width = max(1, -(-longest // PARTS))
    books, before, path = first_codebooks(rows, width), None, None
    if not books.shape[1]:
        books = np.zeros((PARTS, 1, width), dtype=np.int64)
    source = rows
    for turn in range(ROUNDS + 1):
        old, path = path, _written(spark, source.mapInArrow(_round(books, before), _STATE))
        if old:
            remove(spark, old)
        source = spark.read.parquet(path)
        if turn < ROUNDS:
            before, books = books, moved(source, books)
    coded = _written(spark, source.mapInArrow(_finals(books), "vec_id long, label string, code string, error long"))
    remove(spark, path)
    return spark.read.parquet(coded), books


def _written(spark: SparkSession, df: DataFrame) -> str:
    path = table_path(spark, "vectors")
    df.write.parquet(path)
    return path


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: errors summed over equal labels, nulls together. Sums are made before the shuffle; a
    label of very many rows is split by Spark's handling of skewed joins, as its side of sums has one row a label."""
    total: Column = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, coded.label.eqNullSafe(sums["_label"])).drop("_label")


def digests(vectors: DataFrame) -> DataFrame:
    coded, books = compressed(vectors)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
