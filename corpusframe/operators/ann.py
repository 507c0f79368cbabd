"""Approximate nearest neighbours: a trained coarse quantiser with inverted lists in a partitioned table (VEC-02).

Vectors are dealt into lists by their nearest centroid. The centroids come from k-means over a bounded sample; each
round adds up sums by list within tasks and then across them, so that only the centroids come to the driver. The
index holds every row. A search reads the lists that its queries probe: their numbers, bounded by the number of
centroids, prune the table's partitions. Where all lists are probed the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _unit, blocks, nearest, usable

#: Vectors of the sample for each list, rounds of k-means, and the most lists (a matrix of 64 MB at 512 components).
SAMPLE = 64
ROUNDS = 6
MOST_LISTS = 16_384
#: Queries in a block of those that probe one list.
QUERY_BLOCK = 2048
#: Distances to centroids that a task works out at once.
AT_ONCE = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no more than ``AT_ONCE`` distances are held."""
    step = max(1, AT_ONCE // len(centroids))
    for b in batches:
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for b in _slices(batches, centroids):
            if b.num_rows:
                v = _unit(_matrix(b.column("vector")))
                own = (v @ centroids.T).argmax(1)
                np.add.at(sums, own, v)
                counts += np.bincount(own, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["list", "n", "sums"])

    return run


def trained(vectors: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids from at most ``SAMPLE`` vectors a list, those with the least hashes of their ids, so the same in
    every run; the first ``lists`` of them are the start. A list that no vector of the sample is nearest to keeps its
    centroid. Equal vectors count once, so that copies do not make lists of their own."""
    hashed = vectors.withColumn("_h", F.xxhash64(F.lit(1), F.col("vector")))
    n = hashed.agg(F.approx_count_distinct("_h").alias("n")).first()["n"]
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * (2 * SAMPLE * lists + 200) // max(1, n))
    sample = hashed.where(F.col("_h") <= bound).groupBy("_h").agg(F.first("vector").alias("vector")).orderBy("_h").limit(SAMPLE * lists)
    start = sample.limit(lists).collect()
    centroids = _unit(np.array([r["vector"] for r in start], dtype=np.float64))
    sample = sample.persist()
    for _ in range(rounds):
        parts = sample.select("vector").mapInArrow(_sums(centroids), "list int, n long, sums array<double>")
        total = parts.select("list", F.posexplode("sums").alias("at", "v")).groupBy("list", "at").agg(F.sum("v").alias("v"))
        moved = centroids.copy()
        for r in total.collect():
            moved[r["list"], r["at"]] = r["v"]
        centroids = _unit(moved)
    sample.unpersist()
    return centroids


def _nearest_lists(centroids: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, centroids):
            near = np.argsort(-(_unit(_matrix(b.column("vector"))) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(near.ravel())], [*b.schema.names, "list"])

    return run


def _dealt(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(_nearest_lists(centroids, probes), f"id {kind}, vector array<double>, list int")


class Lists:
    """An index in the folder ``path``: ``lists`` (id, vector) partitioned by list, and ``centroids``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
        self.centroids = np.array([r["centroid"] for r in rows])

    @classmethod
    def build(cls, index: DataFrame, path: str, lists: int | None = None) -> Lists:
        """Write an index of ``index`` (id, vector). Unless told otherwise it has as many lists as the square root of its
        rows. Null and empty vectors and those with a null or NaN are left out; one of another length than the
        longest cannot be compared and is an error. A list of very many rows is split over tasks and files."""
        rows = usable(index, "id", "vector")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
        if not size["n"]:
            raise ValueError("no vector to index")
        if size["least"] != size["most"]:
            raise ValueError(f"vectors of {size['least']} to {size['most']} components")
        centroids = trained(rows, min(MOST_LISTS, lists or max(1, round(size["n"] ** 0.5))))
        spark = index.sparkSession
        _dealt(rows, centroids, 1).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls(spark, path)

    def recall(self, queries: DataFrame, k: int, skip_self: bool = False) -> list[float]:
        """The share of the exact k nearest that a search finds with 1, 2, ... lists, for a few ``queries``: from one
        exact search, and the place of each neighbour's list among its query's."""
        asked = _dealt(usable(queries, "q", "vector"), self.centroids, len(self.centroids)).groupBy("id").agg(F.collect_list("list").alias("near"))
        true = nearest(blocks(self.table(), "i").crossJoin(blocks(usable(queries, "q", "vector").coalesce(1), "q")), k, skip_self)
        own = self.table().select(F.col("id"), F.col("list"))
        place = true.select("q", "id").join(own, "id").join(asked.withColumnRenamed("id", "q"), "q").select(F.array_position("near", F.col("list")).alias("at"))
        counts = {r["at"]: r["n"] for r in place.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = np.cumsum([counts.get(i + 1, 0) for i in range(len(self.centroids))])
        return (found / max(1, found[-1])).tolist()

    def calibrated(self, k: int = 10, target: float = 0.97, sample: int = 200) -> int:
        """The fewest lists with which ``sample`` of the index's own rows, those with the least hashes, find that share of
        their k nearest, themselves aside."""
        some = self.table().orderBy(F.xxhash64(F.lit(2), F.col("id")), "id").limit(sample).select(F.col("id").alias("q"), "vector")
        return next(i for i, r in enumerate(self.recall(some, k, skip_self=True), start=1) if r >= target)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def probed(self, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """(rows of the lists that queries probe, (id, vector, list) of the queries)."""
        asked = _dealt(usable(queries, "q", "vector"), self.centroids, probes)
        table = self.table()
        if probes < len(self.centroids):
            wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # at most MOST_LISTS numbers
            table = table.where(F.col("list").isin(wanted))
        return table, asked

    def search(self, queries: DataFrame, k: int, probes: int = 8, skip_self: bool = False) -> DataFrame:
        """(q, id, score, rk) of ``queries`` (q, vector): the k nearest within each one's ``probes`` nearest lists.

        Rows of a list and the queries that probe it meet as blocks, joined by list; Spark sends the queries' blocks to
        every task where they are few, else it deals both out by list and splits lists of very many blocks.
        """
        table, asked = self.probed(queries, probes)
        many = max(1, -(-queries.count() // QUERY_BLOCK))
        dealt = asked.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(many)))
        width = F.lit(self.centroids.shape[1]).alias("q_width")
        packed = dealt.groupBy("list", "_b").agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list("vector")).alias("q_matrix")).select("list", "q_ids", width, "q_matrix")
        return nearest(blocks(table, "i", by="list").join(packed, "list"), k, skip_self)
