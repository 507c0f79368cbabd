"""The page feed: lines of both languages, page after page, become articles, notes, headings and issues (STF-01, STF-02,
MIS-01, JOI-14, FN-01, FN-02).

Only markers and repeal notes need what came before them: those few lines are followed in order by a small state
machine, a document after another in sorted partitions. All else follows from them by windows and joins. A *stretch* is a
run of a page's lines of one table row (or outside the table) that a marker may open; a note goes on to the end of its
stretch, a heading block is a run of bold lines of one that no plain line of the row precedes. Arabic lines that
stand beside or above belong to the first block that claims them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import cut
from ..functions import text as tx
from .hierarchy import hierarchy
from .records import _has_gap, _marker_verdict

#: How far beside a block an Arabic line outside the table may start, in points.
BAND = 4.0
_VERDICT = "doc string, pos long, accepted boolean, note boolean, code string, typo boolean"


def boxed_lines(glyphs: DataFrame) -> DataFrame:
    """(page, line, text, bold, x0, x1, y0): lines from glyphs (page, line, k, c, bold, x0, y0, x1, y1), white ones aside
    (WIN-11): their bounding box, bold if most of them are, English text from left to right. A line of white glyphs
    alone is none."""
    ink = ~F.col("c").rlike(r"^\s*$")
    box = lambda f, c: f(F.when(ink, F.col(c))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "k", "c"))), lambda g: g.c), "")
    lines = glyphs.groupBy("page", "line").agg(text.alias("text"), (2 * F.count(F.when(ink & F.col("bold"), 1)) > F.count(F.when(ink, 1))).alias("bold"), box(F.min, "x0"), box(F.max, "x1"), box(F.min, "y0"))
    return lines.where("y0 IS NOT NULL").withColumn("text", tx.clean_en("text"))


class Feed(NamedTuple):
    """``lines`` (doc, page, lang, pos, text, row, y0, role, number, block), ``blocks`` (doc, block, page, row, kind, en,
    ar), ``notes`` (doc, block, page, first, last, text_en, text_ar), ``articles`` (doc, lang, number, page, row, pos,
    block), ``issues`` (doc, page, lang, pos, level, code, number)."""

    lines: DataFrame
    blocks: DataFrame
    notes: DataFrame
    articles: DataFrame
    issues: DataFrame


def verdicts(candidates: DataFrame, first: int, repealed: list[tuple[int, int]]) -> DataFrame:
    """What the markers and notes of each document are, in their order: the state is the last accepted number of each
    language, the spans of numbers that notes have explained so far, and the stretch of the last note, which holds
    any further one. A line that is an accepted marker is no note."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, last, spans, stretch = object(), {}, [], None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.doc != doc:
                    doc, last, spans, stretch = r.doc, {}, list(repealed), None
                accepted, note, code = False, False, None
                if not pd.isna(r.number):
                    number, seen = int(r.number), last.get(r.lang, first - 1)
                    accepted, code = _marker_verdict(r.lang, number > seen, number > seen and _has_gap(seen, number, spans), bool(r.row_start), bool(r.page_top))
                    if accepted:
                        last[r.lang] = number
                if not accepted and not pd.isna(r.note_first) and (r.given or r.stretch != stretch):
                    note, stretch = True, r.stretch
                    spans.append((int(r.note_first), int(r.note_last)))
                out.append((r.doc, r.pos, accepted, note, code, bool(accepted and r.typo)))
            yield pd.DataFrame(out, columns=["doc", "pos", "accepted", "note", "code", "typo"])

    columns = ["doc", "pos", "lang", "number", "row_start", "page_top", "typo", "note_first", "note_last", "stretch", "given"]
    return candidates.select(columns).repartition("doc").sortWithinPartitions("doc", "pos").mapInPandas(follow, _VERDICT)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines in their order with what their own text and row say of them."""
    doc, page = W.partitionBy("doc"), W.partitionBy("doc", "page", "lang").orderBy("at")
    plain_before = F.max((~F.col("bold")).cast("int")).over(W.partitionBy("doc", "page", "lang", "row").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    own = F.col("text").startswith("م") == (F.col("lang") == "ar")
    m = F.when(own, tx.marker("text"))
    note = F.when(F.col("lang") == "en", tx.repeal_range("text"))
    rows = lines.select(F.col("doc").cast("string").alias("doc"), "page", "lang", "at", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"), "row", F.col("y0").cast("double").alias("y0"))
    rows = rows.withColumn("pos", F.row_number().over(doc.orderBy("page", F.desc("lang"), "at", "text")).cast("long")).withColumn("nth", F.row_number().over(page)).withColumn("row_start", F.col("row").isNull() | (F.coalesce(plain_before, F.lit(0)) == 0))
    rows = rows.withColumn("m", m).withColumn("n", note)
    rows = rows.select("doc", "page", "lang", "pos", "text", "bold", "row", "y0", (F.col("nth") == 1).alias("page_top"), "row_start", F.col("m.number").alias("number"), F.col("m.rest").alias("rest"), F.col("m").isNotNull().alias("marker"), F.col("m.rest").isNotNull().alias("glued"), ((F.col("lang") == "en") & ~F.col("text").startswith("Article ")).alias("misspelt"), F.col("n.first").alias("note_first"), F.col("n.last").alias("note_last"))
    before = W.partitionBy("doc", "lang").orderBy("pos")
    opens = F.col("marker") | ~F.lag("row").over(before).eqNullSafe(F.col("row")) | ~F.lag("page").over(before).eqNullSafe(F.col("page"))
    return rows.withColumn("stretch", F.sum(opens.cast("long")).over(before.rowsBetween(W.unboundedPreceding, 0)))


def _table_seen(rows: DataFrame) -> Column:
    """Whether the document's first table line of the language is this one or before it."""
    first = F.min(F.when(F.col("row").isNotNull(), F.col("pos"))).over(W.partitionBy("doc", "lang"))
    return F.coalesce(F.col("row").isNotNull() | (F.col("pos") >= first), F.lit(False))


def _judged(rows: DataFrame, first: int, repealed: list[tuple[int, int]], notes: DataFrame | None = None) -> DataFrame:
    some = rows.where("marker OR note_first IS NOT NULL").withColumn("typo", F.col("misspelt")).withColumn("given", F.lit(False))
    if notes is not None:
        known = [F.col(c) if c in ("doc", "pos", "note_first", "note_last") else F.lit(None).cast(t).alias(c) if c != "given" else F.lit(True).alias(c) for c, t in some.dtypes]
        some = some.unionByName(notes.select(known))
    told = verdicts(some, first, repealed)
    both = rows.join(told, ["doc", "pos"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("accepted", "note", "typo")})


def fed(lines: DataFrame, first: int = 1, repealed: list[tuple[int, int]] | None = None) -> Feed:
    """The feed of lines (doc, page, lang, at, text, bold, row, y0): ``at`` orders a page's lines of a language, ``row`` is
    null outside the table. ``repealed`` are spans of numbers known to be missing.

    Null texts are empty, null ``bold`` is not bold. English lines of a page come before its Arabic ones. A document's
    lines outside the table before its first table line are its preamble, by language; so a document without a
    table is preamble alone. Rows that repeat are lines of their own.
    """
    repealed = list(repealed or [])
    placed = cut(_placed(lines))
    # texts decide nothing from here on: they stay aside and meet their lines where they are asked for
    texts, placed = placed.select("doc", "pos", "text", "rest"), placed.drop("text", "rest")
    en = placed.where("lang = 'en'")
    en = en.withColumn("preamble", ~_table_seen(en))
    en = _judged(en.where("NOT preamble"), first, repealed).unionByName(en.where("preamble"), allowMissingColumns=True)
    en = en.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("accepted", "note", "typo")})
    run = W.partitionBy("doc", "stretch").orderBy("pos")
    noted = F.max(F.when(F.col("note"), F.col("pos"))).over(run)
    en = en.withColumn("note_block", F.when(~F.col("preamble"), noted))
    bold = F.col("bold") & ~F.col("accepted") & F.col("note_block").isNull() & ~F.col("preamble")
    en = en.withColumn("_bold", bold).withColumn("_opens", bold & F.col("row_start") & ~F.coalesce(F.lag("_bold").over(run), F.lit(False)))
    # a run of bold lines is a block if its first line starts the row
    runs = F.sum((~F.col("_bold")).cast("int")).over(run)
    en = en.withColumn("_run", runs).withColumn("_first", F.max(F.when(F.col("_opens"), F.col("pos"))).over(W.partitionBy("doc", "stretch", "_run").orderBy("pos")))
    en = en.withColumn("block", F.coalesce("note_block", F.when(F.col("_bold"), F.col("_first"))))
    role = F.when(F.col("preamble"), "preamble").when(F.col("accepted"), "marker").when(F.col("note_block").isNotNull(), "note").when(F.col("block").isNotNull(), "heading").otherwise("body")
    en = cut(en.withColumn("role", role).select(*placed.columns, "accepted", "note", "typo", "code", "block", "role"))

    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    joined = lambda texts: tx.strip(F.regexp_replace(F.array_join(texts, " "), r"^[* ]+", ""))
    blocks = en.where("block IS NOT NULL").groupBy("doc", "block").agg(F.first("page").alias("page"), F.first("row").alias("row"), F.first("role").alias("kind"), F.min_by("y0", "pos").alias("y_from"), F.max_by("y0", "pos").alias("y_to"))
    ar = placed.where("lang = 'ar'")
    marked = ar.where("marker AND row IS NOT NULL").groupBy("doc", "page", "row").agg(F.min("y0").alias("marker_y"))
    reach = blocks.select("doc", "page", "row", "block", "kind", "y_from", "y_to").join(marked, ["doc", "page", "row"], "left")
    line, block = ar.where("NOT marker").alias("a"), reach.alias("b")
    above = (F.col("a.row") == F.col("b.row")) & (F.col("b.marker_y").isNull() | (F.col("a.y0") < F.col("b.marker_y")))
    beside = F.col("a.row").isNull() & (F.col("a.bold") | (F.col("b.kind") == "note")) & F.col("a.y0").between(F.col("b.y_from") - BAND, F.col("b.y_to") + BAND)
    claims = line.join(block, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (above | beside)).groupBy(F.col("a.doc").alias("doc"), F.col("a.pos").alias("pos")).agg(F.min("b.block").alias("block"))
    ar = ar.join(claims, ["doc", "pos"], "left")
    left = ar.where("block IS NULL")
    left = left.withColumn("preamble", ~_table_seen(left))
    notes_so_far = en.where("note").select("doc", "pos", "note_first", "note_last")
    judged = _judged(left.where("NOT preamble"), first, repealed, notes_so_far)
    rest = left.where("preamble").unionByName(ar.where("block IS NOT NULL"), allowMissingColumns=True)
    ar = judged.unionByName(rest, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("accepted", "note", "typo")})
    role = F.when(F.col("block").isNotNull(), "claimed").when(F.col("preamble"), "preamble").when(F.col("accepted"), "marker").when(F.col("bold") & F.col("row_start"), "unpaired").otherwise("body")
    ar = cut(ar.withColumn("role", role).select(*placed.columns, "accepted", "note", "typo", "code", "block", "role"))

    arabic = _with_texts(ar.where("block IS NOT NULL"), texts).groupBy("doc", "block").agg(ordered("text").alias("ar"))
    blocks = _with_texts(en.where("block IS NOT NULL"), texts).groupBy("doc", "block").agg(F.first("page").alias("page"), F.first("row").alias("row"), F.first("role").alias("kind"), ordered("text").alias("en"), F.min_by("note_first", "pos").alias("first"), F.min_by("note_last", "pos").alias("last"))
    blocks = blocks.join(arabic, ["doc", "block"], "left").withColumn("ar", F.coalesce("ar", F.array().cast("array<string>")))
    notes = blocks.where("kind = 'note'").select("doc", "block", "page", "first", "last", joined(F.col("en")).alias("text_en"), joined(F.col("ar")).alias("text_ar"))
    both = en.unionByName(ar)
    so_far = W.partitionBy("doc", "lang").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last(F.when(F.col("accepted"), F.struct("number", "page", "row")), ignorenulls=True).over(so_far))
    both = both.withColumn("article", F.col("_own.number"))
    articles = _in_force(both.where("accepted"), en)
    return Feed(_texts(_with_texts(both, texts)), blocks.select("doc", "block", "page", "row", "kind", "en", "ar"), notes, articles, _issues(both))


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines with their ``text`` and ``rest``; those without a document as well."""
    own = texts.select(F.col("doc").alias("_doc"), F.col("pos").alias("_pos"), "text", "rest")
    return rows.join(own, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("pos") == F.col("_pos"))).drop("_doc", "_pos")


def _texts(both: DataFrame) -> DataFrame:
    """Every line with its role; a marker has the text glued to it as its article's first line."""
    number = F.when(F.col("role").isin("marker", "body"), F.col("article"))
    text = F.when(F.col("role") == "marker", F.col("rest")).otherwise(F.col("text"))
    return both.select("doc", "page", "lang", "pos", text.alias("text"), "row", "y0", "role", number.alias("number"), "block")


def _in_force(markers: DataFrame, en: DataFrame) -> DataFrame:
    """Articles with the heading block in force at their marker: the last one before an English marker; an Arabic one has
    that of its English article, if a page up to its own has it, else the last of its page."""
    heads = en.where("role = 'heading'").select("doc", "pos", "page", F.col("block").alias("head"))
    events = en.where("role = 'marker'").select("doc", "pos", "page", F.lit(None).cast("long").alias("head"), "number").unionByName(heads.withColumn("number", F.lit(None).cast("int")))
    last = F.last("head", ignorenulls=True).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    own = events.withColumn("head", last).where("number IS NOT NULL").select("doc", "number", F.col("page").alias("en_page"), F.col("head").alias("en_head"))
    ar = markers.where("lang = 'ar'").select("doc", "pos", F.lit(None).cast("long").alias("head"), F.lit(True).alias("asked"))
    at_page = ar.unionByName(heads.select("doc", "pos", "head", F.lit(False).alias("asked"))).withColumn("head", last).where("asked").select("doc", "pos", "head")
    both = markers.select("doc", "lang", "number", "page", "row", "pos").join(own, ["doc", "number"], "left").join(at_page, ["doc", "pos"], "left")
    known = F.col("en_page") <= F.col("page")
    block = F.when(F.col("lang") == "en", F.col("en_head")).when(known, F.col("en_head")).otherwise(F.col("head"))
    return both.select("doc", "lang", "number", "page", "row", "pos", block.alias("block"))


def _issues(both: DataFrame) -> DataFrame:
    before = F.col("article").isNull()
    level = lambda c: F.when(F.col("row").isNull() | ~F.lit(c), "info").otherwise("warning")
    issue = lambda code, level, number=None: F.struct(F.lit(code).alias("code"), level.alias("level"), (F.lit(None).cast("int") if number is None else number).alias("number"))
    info, warning = F.lit("info"), F.lit("warning")
    body = F.col("role") == "body"
    same_row = (F.col("_own.page") == F.col("page")) & F.col("_own.row").eqNullSafe(F.col("row"))
    told = [
        F.when(F.col("role") == "preamble", issue("PREAMBLE", info)),
        F.when(F.col("code").isNotNull(), F.struct(F.col("code").alias("code"), F.when(F.col("code").isin("AMBIGUOUS_MARKER", "GAP_BEFORE_ARTICLE"), "warning").otherwise("info").alias("level"), F.when(F.col("accepted"), F.col("number")).otherwise(F.col("article")).alias("number"))),
        F.when(F.col("typo"), issue("MARKER_TYPO", info, F.col("number"))),
        F.when(F.col("accepted") & F.col("glued"), issue("MARKER_GLUED", info, F.col("number"))),
        F.when(F.col("note"), issue("REPEAL_NOTE", info)),
        F.when(body & before, issue("TEXT_BEFORE_FIRST_ARTICLE", level(True))),
        F.when(body & ~before & (F.col("lang") == "en") & F.col("row").isNotNull() & F.col("row_start") & ~F.col("page_top") & ~same_row, issue("ROW_WITHOUT_MARKER", info, F.col("article"))),
        F.when(F.col("role") == "unpaired", issue("AR_HEADING_UNPAIRED", info)),
    ]
    lines = both.select("doc", "page", "lang", "pos", F.explode(F.array_compact(F.array(*told))).alias("i")).select("doc", "page", "lang", "pos", "i.level", "i.code", "i.number")
    at = lambda lang: both.where("accepted").where(F.col("lang") == lang).select("doc", "number", *(F.col(c).alias(f"{lang}_{c}") for c in ("page", "row", "pos")))
    pair = at("en").join(at("ar"), ["doc", "number"]).where("en_page <> ar_page OR NOT (en_row <=> ar_row)")
    pair = pair.select("doc", F.col("en_page").alias("page"), F.lit("en").alias("lang"), F.col("en_pos").alias("pos"), F.when(F.col("en_row").isNull() | F.col("ar_row").isNull(), "info").otherwise("warning").alias("level"), F.lit("ROW_MISMATCH").alias("code"), "number")
    pages = both.where("role IN ('marker', 'body') AND article IS NOT NULL").select("doc", F.col("article").alias("number"), "page").distinct()
    pages = pages.withColumn("_first", F.min("page").over(W.partitionBy("doc", "number"))).where("page > _first")
    breaks = pages.select("doc", "page", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("pos"), F.lit("info").alias("level"), F.lit("PAGE_BREAK").alias("code"), "number")
    return lines.unionByName(pair).unionByName(breaks)


def with_hierarchy(feed: Feed, fixes: list[dict] | None = None) -> DataFrame:
    """Articles with the number and titles of each level that is in force at their marker (STF-04)."""
    state = hierarchy(feed.blocks.where("kind = 'heading'").select("doc", "block", "en", "ar"), fixes)
    return feed.articles.join(state, ["doc", "block"], "left")


def drafts(feed: Feed) -> DataFrame:
    """(doc, number, lang, text, page): the texts of articles, a line a line, with the page of their marker (JOI-01)."""
    lines = feed.lines.where("number IS NOT NULL AND text IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "\n")
    made = lines.groupBy("doc", "lang", "number").agg(text.alias("text"))
    return feed.articles.select("doc", "lang", "number", "page").join(made, ["doc", "lang", "number"], "left").withColumn("text", F.coalesce("text", F.lit("")))
