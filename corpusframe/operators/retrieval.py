"""Exact vector search, hybrid merge, re-ranking and chunk de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from .batches import joined, pieces

#: Bytes of vectors in a block, and the most bytes of query vectors that are sent to every task; more queries meet the
#: index block by block, without the driver.
BLOCK_BYTES = 4 << 20
BROADCAST_BYTES = 64 << 20
#: Scores of queries against one block of the index that a task works out at once.
SCORED_AT_ONCE = 1 << 20
#: New scores that a task holds, or as many as it has kept, before it cuts them to k a query.
CUT_ROWS = 200_000


def cosine(a, b) -> Column:
    """Cosine similarity of two float arrays in double precision (VEC-02, NUM-01)."""
    a, b = (x if isinstance(x, Column) else F.col(x) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows whose vector is neither null nor empty and holds no null and no NaN."""
    v = F.col(vector)
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col(key).alias("id"), v.cast("array<double>").alias("vector"))


def _list(values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)


def blocks(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Rows of (id, vector), one Arrow batch after another, as blocks of vectors of one length: ``{name}_ids``,
    ``{name}_width``, ``{name}_matrix``, and ``by``, whose values are not mixed within a block."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{name}_ids", f"{name}_width", f"{name}_matrix", *([by] if by else [])]
        for b in batches:
            vectors, group = b.column("vector"), b.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(b.num_rows, dtype=np.int64)
            widths, starts, flat = np.diff(vectors.offsets.to_numpy()), vectors.offsets.to_numpy()[:-1], vectors.values.to_numpy()
            for g, width in sorted(set(zip(group.tolist(), widths.tolist(), strict=True))):
                at = np.flatnonzero((group == g) & (widths == width))
                for i in range(0, len(at), step := max(1, BLOCK_BYTES // (8 * width))):
                    part = at[i : i + step]
                    matrix = flat[starts[part][:, None] + np.arange(width)].ravel()
                    columns = [_list(b.column("id").take(pa.array(part)), len(part)), pa.array([width], pa.int32()), _list(pa.array(matrix), len(matrix))]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([g], b.column(by).type)] if by else [])], names)

    schema = f"{name}_ids array<{kind}>, {name}_width int, {name}_matrix array<double>" + (f", {by} {rows.schema[by].dataType.simpleString()}" if by else "")
    return rows.select("id", "vector", *([by] if by else [])).mapInArrow(pack, schema)


def nearest(pairs: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(q, id, score, rk) from pairs of index blocks (``i_``) and query blocks (``q_``): a matrix product for each pair
    of vectors of one length; k a query leave a block and a task, of those that tie the ones with the least ids, however
    many copies of a vector there are."""
    q_type, i_type = (pairs.schema[c].dataType.elementType for c in ("q_ids", "i_ids"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pd.DataFrame] = []
        fresh: list[pd.DataFrame] = []
        held = 0
        for b in batches:
            for i_ids, width, i_matrix, q_ids, other, q_matrix in zip(*(b.column(c) for c in ("i_ids", "i_width", "i_matrix", "q_ids", "q_width", "q_matrix")), strict=True):
                if width.as_py() != other.as_py():
                    continue
                shape = (-1, width.as_py())
                own, asked = i_ids.values.to_numpy(zero_copy_only=False), q_ids.values.to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                own, vectors, matrix = own[order], _unit(i_matrix.values.to_numpy().reshape(shape)[order]), q_matrix.values.to_numpy().reshape(shape)
                keep, step = min(k, len(own)), max(1, SCORED_AT_ONCE // len(own))
                for at in range(0, len(asked), step):
                    some = asked[at : at + step]
                    s = np.round(vectors @ _unit(matrix[at : at + step]).T, 4)
                    if skip_self:
                        s[own[:, None] == some[None, :]] = -np.inf
                    bound = np.partition(s, len(own) - keep, axis=0)[len(own) - keep]
                    above, equal = s > bound, s == bound
                    equal &= np.cumsum(equal, axis=0, dtype=np.int32) <= keep - above.sum(axis=0)
                    r, c = np.nonzero((above | equal) & np.isfinite(s))
                    fresh.append(pd.DataFrame({"q": some[c], "id": own[r], "score": s[r, c]}))
                    held += len(r)
                    if held > max(CUT_ROWS, sum(map(len, kept))):
                        kept, fresh, held = [_cut(kept + fresh, k)], [], 0
        if kept or fresh:
            yield from (pa.RecordBatch.from_pandas(x, schema=schema, preserve_index=False) for x in [_cut(kept + fresh, k)])

    out = T.StructType([T.StructField("q", q_type), T.StructField("id", i_type), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return pairs.mapInArrow(score, out).withColumn("rk", rank).where(F.col("rk") <= k)


def top_k(queries: DataFrame, index: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """The k nearest of the index for each query: (q, id, score, rk), best first, ties by id (WIN-01, JOI-15).

    ``queries`` (q, vector) are a stated set and are held against all rows of ``index`` (id, vector) in blocks: each
    task scores its pairs of blocks by matrix products, keeps k a query, and only those are shuffled. Queries up
    to ``BROADCAST_BYTES`` after a count go to every task; beyond it Spark deals the pairs of blocks out. Null
    and empty vectors and those with a null or NaN are no part of it; a vector meets those of its length alone.
    """
    asked = usable(queries, "q", "vector")
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()["n"] * 8
    packed = blocks(asked.coalesce(max(1, -(-size // BROADCAST_BYTES))), "q")
    return nearest(blocks(usable(index, "id", "vector"), "i").crossJoin(F.broadcast(packed) if size <= BROADCAST_BYTES else packed), k, skip_self)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _cut(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    x = pd.concat(parts).sort_values(["q", "score", "id"], ascending=[True, False, True])
    return x.groupby("q").head(k)


def best_per_document(hits: DataFrame, document: str = "doc") -> DataFrame:
    """Of a document's hits the best stays; ranks are counted again (WIN-02)."""
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy("q", document).orderBy("rk"))).where("_n = 1").drop("_n")
    return first.withColumn("rk", F.row_number().over(W.partitionBy("q").orderBy("rk")))


def merge_named(named: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Documents that a question names come first, then the found ones that it does not name, as many as k
    or as it names (JOI-04, LIM-01). ``named`` (q, doc, pos), ``semantic`` (q, doc, rk)."""
    once = semantic.groupBy("q", "doc").agg(F.min("rk").alias("pos"))
    extra = once.join(named.select("q", "doc"), ["q", "doc"], "left_anti").select("q", "doc", F.lit(False).alias("by_number"), "pos")
    both = named.select("q", "doc", F.lit(True).alias("by_number"), "pos").unionByName(extra)
    by_q = W.partitionBy("q")
    ranked = both.withColumn("rk", F.row_number().over(by_q.orderBy(F.desc("by_number"), "pos"))).withColumn("_n", F.sum(F.col("by_number").cast("int")).over(by_q))
    return ranked.where(F.col("rk") <= F.greatest(F.lit(k), "_n")).select("q", "doc", "by_number", "rk")


def rerank(hits: DataFrame, score: str, k: int) -> DataFrame:
    """By a second score, ties in the order they had (WIN-03, MIS-16)."""
    return hits.withColumn("rk", F.row_number().over(W.partitionBy("q").orderBy(F.desc(score), "rk"))).where(F.col("rk") <= k)


def retrieved(asked: DataFrame, index: DataFrame, corpus: DataFrame, k: int, first: int, last: int, fanout: int = 1, second: Column | None = None, candidates: int | None = None) -> DataFrame:
    """The composed search of a question (API-06, LIM-02, MIS-16): (q, doc, score, by_number, in_corpus, rk).

    ``asked`` (q, question, vector), ``index`` (id, doc, vector), ``corpus`` (doc). Documents that a question names by
    number come first, then the nearest of the index: so many chunks are fetched, ``fanout`` for each document
    wanted and each named one, that k different ones stay. Without a ``second`` score all hits come back, with a
    flag for those that the corpus has (API-05). With one, the ``candidates`` that the corpus has are ordered by
    that column over (q, doc) and cut to k."""
    wanted = candidates if second is not None and candidates else k
    numbers = asked.select("q", F.posexplode(tx.numbers_in_question("question", first, last)).alias("pos", "doc")).select("q", F.col("doc").cast("long").alias("doc"), (F.col("pos") + 1).alias("pos"))
    n_named = numbers.groupBy("q").agg(F.count("*").alias("n_named"))
    most = n_named.agg(F.max("n_named")).collect()[0][0] or 0  # one number: the most that a question names
    near = top_k(asked.select("q", "vector"), index.select("id", "vector"), (wanted + most) * fanout).join(n_named, "q", "left")
    near = near.where(F.col("rk") <= (F.lit(wanted) + F.coalesce("n_named", F.lit(0))) * fanout).join(index.select("id", F.col("doc").cast("long").alias("doc")), "id")
    best = near.groupBy("q", "doc").agg(F.min("rk").alias("rk"), F.max("score").alias("score"))
    merged = merge_named(numbers, best.select("q", "doc", "rk"), wanted).join(best.select("q", "doc", "score"), ["q", "doc"], "left")
    merged = merged.withColumn("score", F.when(~F.col("by_number"), F.col("score")))
    known = corpus.select(F.col("doc").cast("long").alias("doc")).distinct().withColumn("in_corpus", F.lit(True))
    hits = merged.join(known, "doc", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))
    if second is not None:
        hits = rerank(hits.where("in_corpus").withColumn("_second", second), "_second", k).drop("_second")
    return hits.select("q", "doc", "score", "by_number", "in_corpus", "rk")


def in_corpus(hits: DataFrame, corpus: DataFrame, on: str = "doc") -> DataFrame:
    """Hits of known documents alone (FLT-03, JOI-03)."""
    return hits.join(corpus.select(on).distinct(), on, "left_semi")


def embedded(df: DataFrame, text: str, out: str, encode: Callable[[list[str]], np.ndarray], prompt: str | None = None) -> DataFrame:
    """Unit vectors of texts by an injected encoder (VEC-01, UDF-01). A model that has a ``prompt`` for questions gets it
    before each of them; documents have none. A null text is empty. The encoder gets some texts at a time, so that a
    worker's memory follows neither the table nor the size of an Arrow batch."""
    kind = pa.list_(pa.float32())

    def units(texts: list[str | None]) -> pa.Array:
        v = _unit(np.asarray(encode([(prompt or "") + (t or "") for t in texts]), dtype=np.float64).reshape(len(texts), -1)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.int32()), pa.array(v.ravel()))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pa.Array) -> pa.Array:
        return joined([units(some) for (some,) in pieces(texts)], kind)

    return df.withColumn(out, vectors(text))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests: hashed words."""
    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        m = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                m[i, h % dim] += 1 if h >> 63 else -1
        return m

    return encode


def scored_pairs(df: DataFrame, query: str, text: str, out: str, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Scores of (query, text) by an injected cross-encoder, which gets some pairs at a time (VEC-04)."""

    @F.arrow_udf("double")
    def score(q: pa.Array, t: pa.Array) -> pa.Array:
        return joined([pa.array(scorer([x or "" for x in a], [x or "" for x in b]), pa.float64()) for a, b in pieces(q, t)], pa.float64())

    return df.withColumn(out, score(query, text))


def judged_once(df: DataFrame, keys: list[str], out: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An expensive judgement once for each distinct input, joined back (STF-09)."""
    return df.join(judge(df.select(keys).distinct()).select(*keys, out), keys, "left")


def prompts(hits: DataFrame) -> DataFrame:
    """The context of each question: its hits (q, rk, doc, text, is_repealed) in their order, each under its
    number, repealed ones marked (STR-26). A question has as many hits as its top k."""
    head = F.concat(F.lit("[Article "), F.col("doc").cast("string"), F.lit("]"), F.when(F.col("is_repealed"), " (REPEALED)").otherwise(""))
    part = F.struct("rk", F.concat_ws("\n", head, F.nullif("text", F.lit(""))).alias("part"))
    return hits.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.part), "\n\n").alias("context"))


def answered(asked: DataFrame, texts: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """Answers with their citations checked (LLM-02): (q, answer, cited, valid, invalid). ``asked`` (q, question), ``texts``
    the hits of each question as :func:`prompts` takes them; a question without hits is asked without articles. A
    citation is valid if the question's hits have the article. ``generate`` is the injected model, a call a question."""
    from .records import generated

    given = texts.groupBy("q").agg(F.array_sort(F.collect_set(F.col("doc").cast("int"))).alias("_given"))
    rows = asked.join(prompts(texts), "q", "left").join(given, "q", "left").withColumn("_message", tx.question_message("question", F.coalesce("context", F.lit(""))))
    told = generated(rows, "_message", "answer", generate).withColumn("cited", tx.extract_citations("answer"))
    checked = told.withColumn("_r", tx.citation_check("cited", F.coalesce("_given", F.array().cast("array<int>"))))
    return checked.select("q", "answer", "cited", "_r.valid", "_r.invalid")
