"""Document fingerprints by winnowing, with DataFrame functions only.

Hashes of ``GRAM`` consecutive words roll over the text; in each window of ``WINDOW`` of them the
smallest is kept, the rightmost one of equals, with its position. Any run of ``GRAM + WINDOW - 1`` words
that two texts share therefore leaves a common hash. A text of fewer words than a gram is one gram, one
of fewer grams than a window is one window. In scripts that are written without blanks each character is a
word; other runs without one are cut after every ``LONGEST`` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

GRAM = 3
WINDOW = 4
LONGEST = 32
#: Thai, Lao, Tibetan, Burmese, Khmer, and the letters of Chinese and Japanese.
WITHOUT_BLANKS = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FFF}\x{3005}-\x{3007}\x{3040}-\x{312F}\x{3190}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
WORD = rf"[{WITHOUT_BLANKS}]|[^\x20\x09-\x0D{WITHOUT_BLANKS}]{{1,{LONGEST}}}"
#: Keys in a span; spans up to the second number are sent to every task (64 MB), beyond it they are joined by shuffle.
SPAN = 512
BROADCAST_SPANS = 4_000_000
#: Spans that one task follows.
RANGE = 100_000
#: Groups of rows without a key.
NULL_GROUPS = 4096
#: A long holds a hash of 32 bits above 31 bits that fall as the position rises, so the least is the rightmost of equals.
_LAST = (1 << 31) - 1


def winnowed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out`` array<long>: the chosen (hash, position) pairs in the order of the text, packed.

    Null, empty and blank texts have none. Every step refers to its array more than once or nests it, so
    that no array is computed again inside a lambda.
    """
    df = df.withColumn("_h", F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    rolled = F.col("_h")
    for i in range(1, GRAM):
        rolled = F.zip_with(rolled, F.slice("_h", i + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    grams = F.when(n >= GRAM, F.slice(rolled, 1, F.greatest(n - GRAM + 1, F.lit(1)))).when(n > 0, F.array(F.xxhash64("_h"))).otherwise(F.expr("cast(array() AS array<bigint>)"))
    packed = lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR((F.lit(_LAST) - i).cast("long"))
    df = df.withColumn("_v", F.transform(grams, packed)).withColumn("_n", F.size("_v"))
    width, v = 1, "_v"
    while width < WINDOW:
        step = min(width, WINDOW - width)
        df = df.withColumn(f"_v{width}", F.zip_with(F.col(v), F.slice(v, step + 1, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.least(a, b)))
        v, width = f"_v{width}", width + step
    df = df.withColumn(out, F.array_distinct(F.slice(v, 1, F.greatest(F.col("_n") - WINDOW + 1, F.lit(1)))))
    return df.drop("_h", "_v", "_n", *(c for c in df.columns if c.startswith("_v") and c[2:].isdigit()))


def hashes(fingerprint: str | Column) -> Column:
    """The distinct hashes of a fingerprint, without positions, as array<int>."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long") - F.lit(1 << 31))).cast("array<int>")


def digest(fingerprint: str) -> Column:
    """One string for a fingerprint; empty for none."""
    return F.when(F.size(fingerprint) == 0, F.lit("")).otherwise(F.sha2(F.array_join(F.col(fingerprint).cast("array<string>"), ","), 256))


def likeness(a: str, b: str) -> Column:
    """Shared to all hashes of two sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _spans(ids: DataFrame, span: int) -> DataFrame:
    """(top, to): the largest id of each span of ids and the span above, which needs it as its lowest row's
    next document; the very largest goes to the lowest span. One row a span. Spans are dealt out by ranges, however
    far apart their ids are, and followed within a range; only one number a range is followed among ranges."""
    tops = cut(ids.where("id is not null").groupBy(F.floor(F.col("id") / span).alias("span")).agg(F.max("id").alias("top")))
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tops.count() // RANGE))
    tops = cut(tops.repartitionByRange(parts, "span").withColumn("g", F.spark_partition_id()))
    groups = tops.groupBy("g").agg(F.min("span").alias("low"))
    above = F.coalesce(F.lag("low").over(W.orderBy(F.col("g").desc())), F.min("low").over(W.partitionBy()))
    within = F.lag("span").over(W.partitionBy("g").orderBy(F.col("span").desc()))
    return tops.join(F.broadcast(groups.select("g", above.alias("next"))), "g").select("top", F.coalesce(within, "next").alias("to"))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's.

    The edited text has its last third replaced by as much of the start of the next document, in
    descending order of the key. Texts move once, to the span of their key, where the next document is
    the next row; a span's first row also goes to the span above. Returns the key, ``n_chars``,
    ``edited``, ``fingerprint``, ``edited_fingerprint`` array<long> and ``near_edited``, ``near_next``
    double.

    A null text is empty. Rows that repeat a key follow one another in the order of their texts' hashes. Rows
    with a null key are no part of that order: they are dealt into ``NULL_GROUPS`` groups by their texts' hashes
    and follow one another within a group; the next document of a group's last row is empty. A text of any length
    is read whole. An empty table gives an empty one. Only the key and the text are read.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    tops = _spans(own.select("id"), span)
    few = tops.count() <= BROADCAST_SPANS
    both = own.join(F.broadcast(tops) if few else tops, F.col("id") == F.col("top"), "left")
    places = F.array(F.struct(F.floor(F.col("id") / span).alias("span"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("span"), F.lit(True).alias("guest")))
    both = both.select("id", "_text", F.explode(F.filter(places, lambda p: ~p.guest | p.span.isNotNull())).alias("p")).select("id", "_text", "p.span", "p.guest")
    both = both.withColumn("part", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("_text"), F.lit(NULL_GROUPS))).otherwise(0))
    # fingerprints are taken behind the shuffle, so that only texts are shuffled
    both = winnowed(both.repartition("span", "part"), "_text", "fingerprint").withColumn("_a", hashes("fingerprint"))
    order = W.partitionBy("span", "part").orderBy("guest", F.col("id").desc(), F.xxhash64("_text"))
    both = both.withColumn("_follows", F.lead(F.struct(F.col("_text").alias("t"), F.col("_a").alias("a"))).over(order)).where("NOT guest")
    third = F.expr("length(_text) div 3").cast("int")
    start = F.substring(F.coalesce("_follows.t", F.lit("")), F.lit(1), third)
    both = both.withColumn("edited", F.concat(F.expr("left(_text, cast(length(_text) - length(_text) div 3 AS int))"), start))
    both = both.withColumn("_next", F.coalesce("_follows.a", F.expr("cast(array() AS array<int>)")))
    both = winnowed(both, "edited", "edited_fingerprint").withColumn("_b", hashes("edited_fingerprint"))
    return both.select(F.col("id").alias(key), F.length("_text").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", likeness("_a", "_b").alias("near_edited"), likeness("_a", "_next").alias("near_next"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("fingerprint").alias("fingerprint"), digest("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
