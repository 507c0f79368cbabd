"""Batches of texts of like length for a model, and their results in the order of the input (WIN-12, VEC-03)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Positions that one window follows; ranks within a length carry on from one piece of positions to the next.
PIECE_BITS = 12
#: Characters of texts that a tokenizer or another model gets at once (bytes, where texts come as Arrow arrays), one row at least.
CHARS_AT_ONCE = 1 << 18


def pieces(*columns: pa.Array) -> Iterator[tuple[list[str | None], ...]]:
    """Rows of text columns, some at a time: only these are Python's strings, whatever an Arrow batch holds."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, at, done = np.cumsum(sizes), 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + CHARS_AT_ONCE, side="right")))
        yield tuple(c.slice(at, to - at).to_pylist() for c in columns)
        at, done = to, int(ends[to - 1])


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """The results of pieces as one array."""
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _runs(budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What each length hands to the next: a table of distinct lengths, longest first."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, left = [], -1, 0
        for n, count in pdf.sort_values("n", ascending=False)[["n", "count"]].itertuples(index=False):
            each = max(1, budget // n) if n > 0 else int(count)
            taken = min(left, count)  # places that the open batch of longer texts still has
            fresh = count - taken
            out.append((n, batch, taken, batch + 1, each))
            opened = -(-fresh // each)
            batch += opened
            left = left - taken if not opened else opened * each - fresh
        return pd.DataFrame(out, columns=["n", "open_batch", "taken", "first_batch", "each"])

    return follow


def packed(lengths: DataFrame, budget: int) -> DataFrame:
    """``lengths`` (id long, n) with ``batch``: longest first, ties by id, as many to a batch as its size, items
    times its longest, stays in the budget; one at least.

    As texts come longest first, a batch that opens at length n holds budget / n of them, whatever follows. So a
    count of each distinct length tells where batches open: that table alone is followed in order, as one task,
    and each length's open batch is handed to the next. The batch of a text then follows from its rank among
    those of its length, which are counted in pieces of ids, so that one very common length is not one task.
    Null lengths count as 0, and texts of length 0 fill up the last batch or are one batch. Rows that repeat an
    id are items of their own. An empty table gives an empty one.
    """
    rows = lengths.withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0))).withColumn("_piece", F.coalesce(F.shiftright(F.col("id").cast("long"), PIECE_BITS), F.lit(-(1 << 62)).cast("long")))
    pieces = rows.groupBy("n", "_piece").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("n").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select("n", "_piece", before.alias("_before"))
    runs = pieces.groupBy("n").agg(F.sum("_c").alias("count")).groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: _runs(budget)(pdf), "n long, open_batch long, taken long, first_batch long, each long")
    rank = F.row_number().over(W.partitionBy("n", "_piece").orderBy("id")) - 1
    ranked = rows.withColumn("_rank", rank).join(offsets, ["n", "_piece"]).join(runs, "n").withColumn("_r", F.col("_rank") + F.col("_before"))
    batch = F.when(F.col("_r") < F.col("taken"), F.col("open_batch")).otherwise(F.col("first_batch") + F.floor((F.col("_r") - F.col("taken")) / F.col("each")))
    return ranked.withColumn("batch", batch.cast("long")).select(*lengths.columns, "batch")


def encoded(texts: DataFrame, budget: int, lengths: Callable[[list[str]], list[int]], encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``texts`` (id long, text) with ``vector``, a unit vector by an injected model that gets padded batches; the
    table is in the order of ids again (VEC-03).

    Lengths come from the model's tokenizer, some texts at a time. A group is one batch, so it holds no more
    than the budget. A null text is an empty one.
    """

    @F.arrow_udf("long")
    def measured(t: pa.Array) -> pa.Array:
        return joined([pa.array(lengths([x or "" for x in some]), pa.int64()) for (some,) in pieces(t)], pa.int64())

    def run(table: pa.Table) -> pa.Table:
        texts = [x or "" for x in table.column("text").to_pylist()]
        v = np.asarray(encode(texts), dtype=np.float64).reshape(len(texts), -1)
        v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)
        return pa.table({"id": table.column("id"), "text": table.column("text"), "vector": pa.array(list(v), pa.list_(pa.float32()))})

    batches = packed(texts.select("id", "text").withColumn("n", measured("text")), budget).select("id", "text", "batch")
    return batches.groupBy("batch").applyInArrow(run, "id long, text string, vector array<float>").orderBy("id")


def spans(tokenizer: Callable[[list[str]], list[list[tuple[int, int]]]]) -> Callable:
    """A column function: the (start, end) character offsets of a text's tokens by an injected tokenizer, as
    two Arrow lists; none for a null or empty text."""
    kind = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def some(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > CHARS_AT_ONCE:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            yield part

    @F.pandas_udf(kind)
    def offsets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            starts, ends = [], []  # a token's offsets are kept as two 32-bit numbers, not as Python's
            for part in some([x if isinstance(x, str) else "" for x in t]):
                for f in tokenizer(part):
                    at = np.array(f, dtype=np.int32).reshape(-1, 2)
                    starts.append(at[:, 0].copy())
                    ends.append(at[:, 1].copy())
            yield pd.DataFrame({"starts": pd.Series(starts, dtype=object), "ends": pd.Series(ends, dtype=object)})

    return offsets


def token_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int, tokenizer: Callable[[list[str]], list[list[tuple[int, int]]]]) -> DataFrame:
    """(key, w, n_tokens, chunk): windows of ``size`` tokens that share ``overlap``, cut from the text at the
    tokenizer's character offsets and stripped (CHK-03, UDF-05, WIN-10).

    Line breaks inside a window stay. A text that fits is one window as it stands, so is an empty one; a null text
    has none. Offsets count characters (code points), as Spark's substring does.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    t = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).withColumn("_o", spans(tokenizer)("_text"))
    t = t.select(key, "_text", F.col("_o.starts").alias("_s"), F.col("_o.ends").alias("_e"), F.size("_o.starts").alias("_n"))
    opens = F.when(F.col("_n") <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_n"), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.col("_n"))))
    t = t.select("*", F.posexplode(opens).alias("w", "_at")).withColumn("_to", F.least(F.col("_at") + size, F.col("_n")))
    begin, end = F.get("_s", F.col("_at")), F.get("_e", F.col("_to") - 1)
    piece = F.regexp_replace(F.substring("_text", begin + 1, end - begin), r"(?U)^\s+|\s+\z", "")
    return t.select(key, "w", (F.col("_to") - F.col("_at")).alias("n_tokens"), F.when(F.col("_n") <= size, F.col("_text")).otherwise(piece).alias("chunk"))
