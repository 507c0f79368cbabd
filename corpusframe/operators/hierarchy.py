"""Numbered bilingual hierarchy from heading blocks: part, book, chapter, section, topic, subtopic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from .records import filled, paired_headings

LEVELS = ["part", "book", "chapter", "section", "topic", "subtopic"]
#: Arabic heading words with an ordinal behind them, and English numbered headings.
KEYWORD_AR = r"^(القسم|الكتاب|الباب|الفصل)\s+(\S+?)\.?(?:\s+(.+))?$"
NUMBERED_EN = r"^([0-9]+)\s*[.\-–]\s*(.+)$"
OTHER_ORDINALS = {"الاول": 1, "الثانى": 2}
_DASH = " — "


def _ordinal(c: Column) -> Column:
    known = {w: i for i, w in enumerate(tx.ORDINALS_AR, 1)} | tx.ORDINAL_PREFIXES | OTHER_ORDINALS
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), c)


def classified(blocks: DataFrame) -> DataFrame:
    """Heading lines of (doc, block, en array, ar array), side by side, with what each of them is (STF-03).

    ``kind``: ``keyword`` names a level; ``title`` is the line behind a keyword that has not both titles on its
    own line; of the others ``topic`` is the first of a block with a number, the English one or, where the English
    does not end in a colon, the Arabic one; the rest is ``subtopic``. ``number``, ``title_en``, ``title_ar`` are
    those of the level that the line sets; a title line completes the keyword's. The blocks are dealt out by document
    as they come, before a line has columns of its own."""
    by = W.partitionBy("doc").orderBy("block", "i")
    p = paired_headings(blocks.repartition("doc"), ["doc", "block"]).withColumn("en", tx.strip("en")).withColumn("ar", tx.strip("ar"))
    p = p.withColumn("k", tx.heading_keyword("en")).withColumn("rest_en", F.nullif(tx.strip("k.rest"), F.lit("")))
    am = F.col("ar").rlike(KEYWORD_AR)
    p = p.withColumn("word_ar", F.when(am, F.regexp_extract("ar", KEYWORD_AR, 2))).withColumn("rest_ar", F.when(am & F.col("k").isNotNull(), tx.clean_title_ar(F.regexp_extract("ar", KEYWORD_AR, 3))))
    p = p.withColumn("waits", F.col("k").isNotNull() & (F.col("rest_en").isNull() | F.col("rest_ar").isNull()))
    p = p.withColumn("key", F.when(F.col("waits"), F.struct("k.level", "k.number", "rest_en", "rest_ar")))
    p = p.withColumn("before", F.when(F.col("k").isNull(), F.lag("key").over(by)))
    other = F.col("k").isNull() & F.col("before").isNull()
    # a cast that fails costs an exception: only digits are cast
    p = p.withColumn("_other", other).withColumn("num_en", F.when(F.col("_other") & F.col("en").rlike(NUMBERED_EN), F.regexp_extract("en", NUMBERED_EN, 1).try_cast("int")))
    p = p.withColumn("_n", F.when(F.col("_other") & (F.col("ar") != ""), tx.ar_number("ar"))).withColumn("num_ar", F.col("_n.number")).withColumn("plain_ar", F.col("_n.title"))
    numbered = F.col("_other") & (F.col("num_en").isNotNull() | (~F.col("en").endswith(":") & F.col("num_ar").isNotNull()))
    p = p.withColumn("numbered", numbered).withColumn("nth", F.sum(F.col("numbered").cast("int")).over(W.partitionBy("doc", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    topic = F.col("numbered") & (F.col("nth") == 1)
    kind = F.when(F.col("k").isNotNull(), "keyword").when(F.col("before").isNotNull(), "title").when(topic, "topic").otherwise("subtopic")
    p = p.withColumn("kind", kind)
    b = F.col("before")
    whole_ar = F.when(b.rest_ar.isNull(), tx.clean_title_ar("ar")).when(b.rest_en.isNull() & (F.col("ar") != ""), tx.clean_title_ar(F.concat(b.rest_ar, F.lit(" "), F.col("ar")))).otherwise(b.rest_ar)
    of = lambda keyword, title, topic, rest: F.when(F.col("kind") == "keyword", keyword).when(F.col("kind") == "title", title).when(F.col("kind") == "topic", topic).otherwise(rest)
    p = p.withColumn("_raw", of(F.col("rest_en"), F.coalesce(b.rest_en, "en"), F.when(F.col("num_en").isNotNull(), F.regexp_extract("en", NUMBERED_EN, 2)).otherwise(F.col("en")), F.col("en")))
    p = p.withColumn("_raw", tx.bare_title_en("_raw"))
    return p.select(
        "doc",
        "block",
        "i",
        "en",
        "ar",
        "kind",
        of(F.col("k.level"), b.level, F.lit("topic"), F.lit("subtopic")).alias("level"),
        of(F.col("k.number"), b.number, F.coalesce("num_en", "num_ar"), F.lit(None)).alias("number"),
        tx.smart_title("_raw").alias("title_en"),
        F.when(F.col("kind").isin("keyword", "title"), of(F.col("rest_ar"), whole_ar, F.lit(None), F.lit(None))).otherwise(tx.clean_title_ar("plain_ar")).alias("title_ar"),
        "waits",
        (F.col("k").isNotNull() & (_ordinal(F.col("word_ar")) != F.col("k.number"))).alias("number_differs"),
        (topic & F.col("num_en").isNotNull() & (F.col("num_ar") != F.col("num_en"))).alias("topic_differs"),
    )


def _level_rows(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, block, at, level, number, title_en, title_ar, kind): what is set, in the order of ``at`` within a block;
    a block's subtopics are one, set last. ``keep`` names other columns of a line. Lines that a document's rows hold
    together are neither dealt out nor joined again."""
    by = W.partitionBy("doc", "block").orderBy("i")
    so_far, whole = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sub = F.col("kind") == "subtopic"
    said = lambda c: F.collect_list(F.when(sub & (F.col(c) != ""), F.struct("i", F.col(c).alias("t")))).over(whole)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.t), _DASH)
    seen = lines.withColumns({"_en": said("title_en"), "_ar": said("title_ar"), "_sub": F.count(F.when(sub, 1)).over(so_far), "_subs": F.count(F.when(sub, 1)).over(whole)})
    last = seen.where(~sub | (F.col("_sub") == F.col("_subs")))
    of = lambda a, b, name: F.when(sub, a).otherwise(b).alias(name)
    titles = of(ordered("_en"), F.col("title_en"), "title_en"), of(F.nullif(ordered("_ar"), F.lit("")), F.col("title_ar"), "title_ar")
    return last.select("doc", "block", of(F.lit(1e9), F.col("i").cast("double"), "at"), "level", of(F.lit(None), F.col("number"), "number"), *titles, "kind", *keep)


def corrected(rows: DataFrame, fixes: list[dict], keep: tuple[str, ...] = ()) -> DataFrame:
    """Level rows with parts that the text leaves out (MIS-04): each fix (number, starts_at_book, title_en, title_ar),
    in rising order, holds from a book on. Where the part in force is a lower one or none the part is added
    before the book; where it is the part itself its missing titles are filled. The book's own row gives the part's, so that
    a document's rows stay together; parts added before one book stand in the order of the fixes. ``keep`` names
    other columns, null in an added row."""
    for k, fix in enumerate(sorted(fixes, key=lambda f: f["number"]), 1):
        by = W.partitionBy("doc").orderBy("block", "at")
        before, so_far = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)
        part = F.when(F.col("level") == "part", F.struct("number", "title_en", "title_ar"))
        p = F.col("_part")
        book = (F.col("level") == "book") & (F.col("kind") == "keyword") & (F.col("number") >= fix["starts_at_book"])
        wanted = F.when(p.isNull() | (p.number < fix["number"]), "added").when((p.number == fix["number"]) & (p.title_en.isNull() | p.title_ar.isNull()), "filled")
        seen = rows.withColumn("_part", F.last(part, ignorenulls=True).over(before)).withColumn("_what", F.when(book, wanted))
        # the first one behind each part
        seen = seen.withColumn("_n", F.count("_what").over(so_far)).withColumn("_before", F.last(F.when(F.col("level") == "part", F.col("_n")), ignorenulls=True).over(before))
        new = F.col("_what").isNotNull() & (F.col("_n") - F.coalesce("_before", F.lit(0)) == 1)
        title = lambda c: F.when(F.col("_what") == "filled", F.coalesce(p[c], F.lit(fix[c]))).otherwise(F.lit(fix[c])).alias(c)
        own = F.struct("at", "level", "number", "title_en", "title_ar", "kind", *keep)
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep]
        added = F.struct((F.col("at") - 0.5 / k).alias("at"), F.lit("part").alias("level"), F.lit(fix["number"]).cast("int").alias("number"), title("title_en"), title("title_ar"), F.col("_what").alias("kind"), *none)
        rows = seen.select("doc", "block", F.inline(F.when(new, F.array(added, own)).otherwise(F.array(own))))
    return rows


def _in_force(rows: DataFrame) -> DataFrame:
    """Level rows with what is in force at each: a struct for each level, null where a higher one has ended it. One
    window over a document numbers the rows and fills all levels."""
    order = ["block", "at"]
    placed = rows.withColumn("pos", F.row_number().over(W.partitionBy("doc").orderBy(*order)))
    wide = placed.select("*", *(F.when(F.col("level") == x, F.struct("number", "title_en", "title_ar")).alias(x) for x in LEVELS))
    return filled(wide, "doc", "pos", LEVELS, keep=rows.columns, order=order)


def hierarchy(blocks: DataFrame, fixes: list[dict] | None = None) -> DataFrame:
    """(doc, block, number and titles of each level): what is in force behind each heading block (STF-03, MIS-04)."""
    state = _in_force(corrected(_level_rows(classified(blocks)), fixes or []))
    after = F.lead("block").over(W.partitionBy("doc").orderBy("block", "at"))
    last = state.withColumn("_after", after).where("NOT (_after <=> block)")
    columns = [F.col(x)[c].alias(f"{x}_{c}") for x in LEVELS for c in ("number", "title_en", "title_ar") if (x, c) != ("subtopic", "number")]
    return last.select("doc", "block", *columns)


def heading_issues(blocks: DataFrame, fixes: list[dict] | None = None) -> DataFrame:
    """(doc, block, level, code) (STF-03): numbers that differ between the languages, keyword levels that do not rise
    under their parent, headings that end a block without an Arabic title, and parts from the corrections.

    A document's lines are followed once, in windows of one order: nothing but the blocks is dealt out, joined or stored."""
    lines, keep = classified(blocks), ("number_differs", "topic_differs", "open")
    # the level whose titles a block's last line still waits for
    whole = W.partitionBy("doc", "block").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lines = lines.withColumn("open", F.last(F.when(F.col("waits"), F.col("level"))).over(whole))
    state = _in_force(corrected(_level_rows(lines, keep), fixes or [], keep))
    by, block = W.partitionBy("doc").orderBy("block", "at"), W.partitionBy("doc", "block")
    fixed = F.col("kind").isin("added", "filled")
    fix = F.struct("number", "kind")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    state = state.withColumns({"_old": F.lag(F.struct(*(F.col(x).number.alias(x) for x in LEVELS[:4]))).over(by), "_known": F.collect_set(F.when(fixed, fix)).over(before)})
    state = state.withColumns({"_set": F.collect_set(F.when(~fixed, F.col("level"))).over(block), "_end": F.max("pos").over(block)})
    any_of = lambda cs: reduce(Column.__or__, cs)
    falls = any_of((F.col("level") == x) & (F.col("number") <= F.col(f"_old.{x}")) for x in LEVELS[:4])
    found = [(F.col("number_differs"), "HEADING_NUMBER_MISMATCH", F.col("level")), (F.col("topic_differs"), "TOPIC_NUMBER_MISMATCH", F.col("level")), ((F.col("kind") == "keyword") & falls, "HEADING_ORDER", F.col("level"))]
    first = ~F.array_contains("_known", fix)
    found += [((F.col("kind") == kind) & first, code, F.lit("part")) for kind, code in (("added", "PART_CORRECTION"), ("filled", "PART_TITLE_FROM_OFFICIAL"))]
    for x in LEVELS:
        bare = (F.col(f"{x}.title_en") != "") & F.col(f"{x}.title_ar").isNull() & ~F.lit(x).eqNullSafe(F.col("open"))
        found.append(((F.col("pos") == F.col("_end")) & F.array_contains("_set", x) & bare, "HEADING_NO_ARABIC", F.lit(x)))
    codes = F.array_compact(F.array(*(F.when(c, F.struct(level.alias("level"), F.lit(code).alias("code"))) for c, code, level in found)))
    return state.where(any_of(c for c, _, _ in found)).select("doc", "block", F.inline(codes))
