"""Queries over bilingual text: the tables are Latin, so that Arabic lines are made from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hierarchy as hi
from ..operators import records as rec
from .registry import query
from .registry import table as _t

_AR = "translate({}::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩')"


def _cases(spark, d, cases: list[str]) -> DataFrame:
    """Every document with one of the lines, ``#`` in it standing for its number in Arabic digits, ``@`` in Western ones."""
    line = F.element_at(F.array(*map(F.lit, cases)), F.expr(f"cast(doc_id % {len(cases)} + 1 AS int)"))
    number = F.translate(F.col("doc_id").cast("string"), "0123456789", tx.ARABIC_DIGITS)
    return _t(spark, d, "documents").select("doc_id", F.replace(F.replace(line, F.lit("#"), number), F.lit("@"), F.col("doc_id").cast("string")).alias("c"))


def _wanted(cases: list[str | None]) -> str:
    """The SQL for what each line is to give."""
    quoted = lambda x: "NULL" if x is None else "replace(replace('" + x.replace("'", "''") + f"', '#', {_AR.format('doc_id')}), '@', doc_id::VARCHAR)"
    return f"CASE doc_id % {len(cases)} " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(cases)) + " END"


_CLEAN = {"(#( نص  العقد": "(#) نص العقد", ")#) حكم": "(#) حكم", "#( البيع": "#) البيع", "(أ( شرط ،ثم": "(أ) شرط،ثم", "(جـ) ثالث": "(جـ) ثالث", " نص ( آخر !": "نص آخر!", "وسط #( يبقى": "وسط #( يبقى", "يعلم ذا الامر": "يعلم بهذا الامر", "قي ": "قيلمه"}


@query(f"SELECT doc_id, {_wanted(list(_CLEAN.values()))} AS clean FROM documents")
def arabic_cleaned(spark, d):
    return _cases(spark, d, list(_CLEAN)).select("doc_id", tx.clean_ar("c").alias("clean"))


_PLAIN = {"أَحْكَام إلى #": "احكام الي #", "آخِرُ ٱلعقـــد": "اخر العقد", "على مصطفى @": "علي مصطفي @"}


@query(f"SELECT doc_id, {_wanted(list(_PLAIN.values()))} AS plain FROM documents")
def arabic_normalized(spark, d):
    return _cases(spark, d, list(_PLAIN)).select("doc_id", tx.normalize_ar("c").alias("plain"))


_TITLES = {"OBLIGATIONS OR PERSONAL RIGHTS:": "Obligations or Personal Rights", "AS TO  THE SALE @.": "As to the Sale @", "SALE AS A CONTRACT": "Sale as a Contract", "Of Sale. ": "Of Sale"}


@query(f"SELECT doc_id, {_wanted(list(_TITLES.values()))} AS title FROM documents")
def english_titles(spark, d):
    return _cases(spark, d, list(_TITLES)).select("doc_id", tx.clean_title_en("c").alias("title"))


_TITLES_AR = {"(البيع #)": "البيع #", "(البيع @):": "البيع @)", "الإيجار:.": "الإيجار", "[نص]": "[نص]", "()": None, "": None}


@query(f"SELECT doc_id, {_wanted(list(_TITLES_AR.values()))} AS title FROM documents")
def arabic_titles(spark, d):
    return _cases(spark, d, list(_TITLES_AR)).select("doc_id", tx.clean_title_ar("c").alias("title"))


_MARKS = {"Article @": ("@", None), "rticle @": ("@", None), "Article@": ("@", None), "Article @ The sale": ("@", "The sale"), "Article @ of the law": (None, None), "Article (@):": (None, None), "مادة )#(": ("@", None), "مادة #": ("@", None), "مادة (#) كل عقد": ("@", "كل عقد"), "see Article @": (None, None)}


@query(f"SELECT doc_id, ({_wanted([n for n, _ in _MARKS.values()])})::INT AS number, {_wanted([r for _, r in _MARKS.values()])} AS rest FROM documents")
def article_markers(spark, d):
    return _cases(spark, d, list(_MARKS)).select("doc_id", tx.marker("c").alias("m")).select("doc_id", "m.number", "m.rest")


_NOTES = {"Articles 54-@ were repealed by law": ("54", "@"), "Article 3 – @: REPEALED": ("3", "@"), "Articles 5 to 9 apply": (None, None)}


@query(f"SELECT doc_id, ({_wanted([a for a, _ in _NOTES.values()])})::INT AS first, ({_wanted([b for _, b in _NOTES.values()])})::INT AS last FROM documents")
def repeal_notes(spark, d):
    return _cases(spark, d, list(_NOTES)).select("doc_id", tx.repeal_range("c").alias("r")).select("doc_id", "r.first", "r.last")


_NUMBERED = {"#- الشخص الطبيعي": ("@", "الشخص الطبيعي"), "أولًا:- أركان العقد": ("1", "أركان العقد"), "سادسا - بيع": ("6", "بيع"), "البيع": (None, "البيع")}


@query(f"SELECT doc_id, ({_wanted([a for a, _ in _NUMBERED.values()])})::INT AS number, {_wanted([b for _, b in _NUMBERED.values()])} AS title FROM documents")
def arabic_heading_numbers(spark, d):
    return _cases(spark, d, list(_NUMBERED)).select("doc_id", tx.ar_number("c").alias("n")).select("doc_id", "n.number", "n.title")


# --- layout ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS line, 'الأم ' || {_AR.format('doc_id')} || ' م' AS text, CASE WHEN doc_id % 2 = 1 AND reverse(doc_id::VARCHAR) <> doc_id::VARCHAR THEN {_AR.format('doc_id')} END AS shown, CASE WHEN doc_id % 2 = 1 AND reverse(doc_id::VARCHAR) <> doc_id::VARCHAR THEN reverse({_AR.format('doc_id')}) END AS stored FROM documents")
def arabic_lines(spark, d):
    """Glyphs of a line: an alef without width before the lam; a number, with a space inside it, that odd rows store backwards."""
    digits = F.split(F.translate(F.col("doc_id").cast("string"), "0123456789", tx.ARABIC_DIGITS), "")
    n = F.size(digits)
    glyph = lambda k, c, x0, x1: F.struct(k.cast("int").alias("k"), c.alias("c"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"))
    letters = [("ا", 528.8, 531), ("أ", 528.7, 528.7), ("ل", 522, 528), ("م", 515, 521), (" ", 511, 514)]
    head = [glyph(F.lit(k), F.lit(c), F.lit(a), F.lit(b)) for k, (c, a, b) in enumerate(letters)]
    run = F.transform(digits, lambda c, i: glyph(F.when(F.expr("doc_id % 2 = 1"), 5 + n - i).otherwise(5 + i), c, 500 - 12 * (n - i), 500 - 12 * (n - i) + 5))
    gap = F.when(n > 1, F.array(glyph(F.lit(90), F.lit(" "), 500 - 12 * n + 6, 500 - 12 * n + 11)))
    tail = [glyph(F.lit(98), F.lit(" "), 400 + F.lit(0), F.lit(405)), glyph(F.lit(99), F.lit("م"), F.lit(390), F.lit(395))]
    every = F.concat(F.array(*head), run, F.coalesce(gap, F.array().cast("array<struct<k:int,c:string,x0:double,x1:double>>")), F.array(*tail))
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("line"), F.explode(every).alias("g")).select("line", "g.*")
    return rec.arabic_line(rows).select("line", "text", F.expr("try_element_at(alts, 1).shown AS shown"), F.expr("try_element_at(alts, 1).stored AS stored"))


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'نص ٢١ و ٢١٣ و ٣١٢' WHEN 1 THEN 'نص ١٢ و ٢١٣ و ٣١٢' ELSE 'نص ١٢ و ٢١٣ و ٢١٣' END AS text FROM documents")
def digits_resolved(spark, d):
    english = F.expr("CASE doc_id % 3 WHEN 0 THEN 'of 21 and 312' WHEN 1 THEN 'of 12 and 21' ELSE 'no 213' END")
    alts = F.expr("array(named_struct('shown', '١٢', 'stored', '٢١'), named_struct('shown', '٣١٢', 'stored', '٢١٣'))")
    return _t(spark, d, "documents").select("doc_id", rec.resolved_digits(F.lit("نص ١٢ و ٢١٣ و ٣١٢"), alts, english).alias("text"))


_SQL_LINES = r"""WITH l AS (SELECT doc_id AS doc, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ', '\1' || chr(10), 'g'), chr(10)) AS x FROM documents)),
 x AS (SELECT *, CASE WHEN {ar} THEN 600 - 5 * length(text) ELSE 40 END::DOUBLE AS x0, CASE WHEN {ar} THEN 600 ELSE 40 + 5 * length(text) END::DOUBLE AS x1 FROM l),"""
_SQL_JOINED = r""" p AS (SELECT *, lag(text) OVER w AS b, {room} AS room, (x1 - x0) / greatest(length(text), 1) AS width FROM x WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 j AS (SELECT *, CASE WHEN b IS NULL THEN '' WHEN regexp_matches(text, '{item}') OR (regexp_matches(b, '[.:;؛]$') AND room > (length(regexp_extract(text, '^\s*(\S*)', 1)) + 1) * width) THEN chr(10) {glue} ELSE ' ' END AS joint FROM p)
 SELECT doc, md5(string_agg(joint || text, '' ORDER BY pos)) AS digest FROM j GROUP BY doc"""


def _layout(spark, d, arabic: bool) -> DataFrame:
    text = F.split(F.regexp_replace("text", r"([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ", "$1\n"), "\n")
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(text).alias("pos", "text"))
    n = F.length("text") * 5
    x0, x1 = (F.lit(600) - n, F.lit(600)) if arabic else (F.lit(40), F.lit(40) + n)
    return rows.withColumn("x0", x0.cast("double")).withColumn("x1", x1.cast("double"))


@query(_SQL_LINES.replace("{ar}", "FALSE") + _SQL_JOINED.replace("{room}", "max(x1) OVER (PARTITION BY doc) - lag(x1) OVER w").replace("{item}", rec.ITEMS["en"]).replace("{glue}", r"WHEN regexp_matches(b, '-$') AND regexp_matches(text, '^\p{Ll}') THEN ''"))
def paragraphs_english(spark, d):
    return rec.paragraphs(_layout(spark, d, False), "en").select("doc", F.md5("text").alias("digest"))


@query(_SQL_LINES.replace("{ar}", "TRUE") + _SQL_JOINED.replace("{room}", "lag(x0) OVER w - min(x0) OVER (PARTITION BY doc)").replace("{item}", rec.ITEMS["ar"]).replace("{glue}", ""))
def paragraphs_arabic(spark, d):
    return rec.paragraphs(_layout(spark, d, True), "ar").select("doc", F.md5("text").alias("digest"))


@query("WITH l AS (SELECT l_suppkey AS page, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey END AS row, l_orderkey * 10 + l_linenumber AS pos, max(l_tax) > 0.04 AS bold FROM lineitem GROUP BY ALL) SELECT page, row, pos, row IS NULL OR coalesce(bool_and(bold) OVER (PARTITION BY page, row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS row_start FROM l")
def table_row_starts(spark, d):
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page"), F.expr("if(l_orderkey % 4 > 0, l_orderkey, null)").alias("row"), F.expr("l_orderkey * 10 + l_linenumber").alias("pos")).agg((F.max("l_tax") > 0.04).alias("bold"))
    return rec.row_starts(lines).select("page", "row", "pos", "row_start")


_SQL_GLYPHS = "WITH g AS (SELECT doc_id AS page, i AS k, substr(t, i, 1) AS c, ((i - 1) % 40) + 0.5 AS x, ((i - 1) // 40) + 0.5 AS y FROM (SELECT doc_id, text AS t, unnest(range(1, length(text) + 1)) AS i FROM documents))"


@query(_SQL_GLYPHS + " SELECT page, regexp_replace(regexp_replace(string_agg(c, '' ORDER BY y, x, k), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM g WHERE NOT (x BETWEEN 10 AND 30 AND y BETWEEN 1 AND 3) GROUP BY page")
def outside_tables(spark, d):
    pages = _t(spark, d, "documents").where("text IS NOT NULL").groupBy(F.col("doc_id").alias("page")).agg(F.collect_list("text").alias("texts"))
    place = lambda c, k: F.struct(k.alias("k"), c.alias("c"), (k % 40 + 0.5).alias("x"), (F.floor(k / 40) + 0.5).alias("y"))
    glyphs = F.flatten(F.transform("texts", lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0)), place)))
    cells = pages.select("page").selectExpr("page", "1 AS cell", "10D AS x0", "30D AS x1", "1D AS y0", "3D AS y1")
    return rec.outside_text(pages, glyphs, cells)


@query("""WITH RECURSIVE g AS (SELECT l_suppkey AS page, l_extendedprice AS y FROM lineitem),
 f AS (SELECT page, min(y) AS top, 0 AS line FROM g GROUP BY page UNION ALL SELECT f.page, min(g.y), any_value(f.line) + 1 FROM f JOIN g ON g.page = f.page AND g.y >= f.top + 500 GROUP BY f.page)
 SELECT g.page, f.line, count(*) AS n, f.top FROM g ASOF JOIN f ON g.page = f.page AND g.y >= f.top GROUP BY g.page, f.line, f.top""")
def lines_of_glyphs(spark, d):
    g = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("page"), F.expr("l_orderkey * 10 + l_linenumber").alias("k"), F.lit("x").alias("c"), F.lit(0.0).alias("x"), F.col("l_extendedprice").alias("y"))
    return rec.grouped_lines(g, 500.0).groupBy("page", "line").agg(F.count("*").alias("n"), F.min("y").alias("top"))


# --- headings ----------------------------------------------------------------------------------------------------

_SQL_BLOCKS = """WITH b AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS block, min(l_partkey) AS p, min(l_linenumber) AS kind, min(l_orderkey) % 9 + 1 AS n FROM lineitem GROUP BY 1, 2),
 f AS (SELECT *, CASE kind WHEN 1 THEN 'book' WHEN 2 THEN 'chapter' WHEN 3 THEN 'section' WHEN 4 THEN 'topic' ELSE 'subtopic' END AS level FROM b)"""


def _blocks(spark, d) -> DataFrame:
    """A heading block for each order line: books and sections with both titles on one line, chapters with a title
    line, topics numbered in one or both languages, subtopics of two lines; every tenth number differs. Order lines
    are dealt out by document before they become text."""
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey").repartition("doc")
    b = lines.groupBy("doc", F.expr("l_orderkey * 10 + l_linenumber").alias("block")).agg(F.min("l_partkey").alias("p"), F.min("l_linenumber").alias("kind"), (F.min("l_orderkey") % 9 + 1).cast("int").alias("n"))
    roman = F.element_at(F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), F.col("n"))
    word = F.element_at(F.array(*map(F.lit, tx.ORDINALS_AR)), F.when(F.expr("p % 10 = 0"), F.col("n") + 1).otherwise(F.col("n")))
    p = F.col("p").cast("string")
    say = lambda *x: F.concat(*(y if not isinstance(y, str) else F.lit(y) for y in x))
    en = F.when(F.col("kind") == 1, F.array(say("BOOK ", roman, " Title ", p))).when(F.col("kind") == 2, F.array(say("Chapter ", roman, "."), say("Title ", p))).when(F.col("kind") == 3, F.array(say("SECTION ", roman, " Title ", p)))
    en = en.when(F.col("kind") == 4, F.array(F.when(F.expr("p % 2 = 0"), say(F.col("n").cast("string"), ". Title ", p)).otherwise(say("Title ", p)))).otherwise(F.array(say("Title ", p), F.lit("Second one: of two")))
    ar = F.when(F.col("kind") == 1, F.array(say("الكتاب ", word, " عنوان ", p))).when(F.col("kind") == 2, F.array(say("الباب ", word), say("عنوان ", p))).when(F.col("kind") == 3, F.array(say("الفصل ", word, " عنوان ", p)))
    number = F.translate(F.when(F.expr("p % 10 = 0"), F.col("n") + 1).otherwise(F.col("n")).cast("string"), "0123456789", tx.ARABIC_DIGITS)
    ar = ar.when(F.col("kind") == 4, F.array(say(number, "- عنوان ", p))).otherwise(F.array(say("عنوان ", p), F.lit("ثان")))
    return b.select("doc", "block", en.alias("en"), ar.alias("ar"))


_FIXES = [{"number": 1, "starts_at_book": 3, "title_en": "Part One", "title_ar": "قسم"}]
_SQL_STATE = _SQL_BLOCKS + ", x AS (SELECT *, " + ", ".join(f"max(CASE WHEN level = '{x}' THEN block END) OVER w AS {x}_at" for x in hi.LEVELS[1:]) + ", min(CASE WHEN level = 'book' AND n >= 3 THEN block END) OVER (PARTITION BY doc) AS part_at FROM f WINDOW w AS (PARTITION BY doc ORDER BY block ROWS UNBOUNDED PRECEDING)),"
_SQL_STATE += " y AS (SELECT doc, block, part_at <= block AS part" + "".join(f", CASE WHEN {x}_at > greatest(-1, coalesce(part_at - CASE WHEN part_at <= block THEN 0 ELSE 1e18 END - 0.5, -1){''.join(f', coalesce({y}_at, -1)' for y in hi.LEVELS[1 : i + 1])}) THEN {x}_at END AS {x}_at" for i, x in enumerate(hi.LEVELS[1:])) + " FROM x)"


@query(
    _SQL_STATE
    + " SELECT y.doc, y.block, CASE WHEN y.part THEN 1 END AS part_number"
    + "".join(f", {x}.n AS {x}_number, 'Title ' || {x}.p AS {x}_title_en" for x in hi.LEVELS[1:5])
    + ", 'Title ' || subtopic.p || ' — Second one: of two' AS subtopic_title_en, CASE WHEN book.p IS NOT NULL THEN 'عنوان ' || book.p END AS book_title_ar, CASE WHEN chapter.p IS NOT NULL THEN 'عنوان ' || chapter.p END AS chapter_title_ar, CASE WHEN section.p IS NOT NULL THEN 'عنوان ' || section.p END AS section_title_ar FROM y "
    + " ".join(f"LEFT JOIN f {x} ON {x}.doc = y.doc AND {x}.block = y.{x}_at" for x in hi.LEVELS[1:])
)
def hierarchy_states(spark, d):
    h = hi.hierarchy(_blocks(spark, d), _FIXES)
    return h.select("doc", "block", "part_number", *(c for x in hi.LEVELS[1:5] for c in (f"{x}_number", f"{x}_title_en")), "subtopic_title_en", "book_title_ar", "chapter_title_ar", "section_title_ar")


@query(
    _SQL_STATE
    + """, s AS (SELECT f.*, y.part, lag(y.book_at) OVER w AS ob, lag(y.chapter_at) OVER w AS oc, lag(y.section_at) OVER w AS os FROM f JOIN y USING (doc, block) WINDOW w AS (PARTITION BY doc ORDER BY block)),
 o AS (SELECT s.*, CASE level WHEN 'book' THEN ob WHEN 'chapter' THEN oc WHEN 'section' THEN os END AS old, level = 'book' AND n >= 3 AND block = min(CASE WHEN level = 'book' AND n >= 3 THEN block END) OVER (PARTITION BY doc) AS fixed FROM s),
 i AS (SELECT doc, block, level, 'HEADING_NUMBER_MISMATCH' AS code FROM f WHERE kind <= 3 AND p % 10 = 0 UNION ALL SELECT doc, block, level, 'TOPIC_NUMBER_MISMATCH' FROM f WHERE kind = 4 AND p % 10 = 0 AND p % 2 = 0
  UNION ALL SELECT o.doc, o.block, o.level, 'HEADING_ORDER' FROM o JOIN f q ON q.doc = o.doc AND q.block = o.old WHERE o.n <= q.n AND NOT o.fixed
  UNION ALL SELECT doc, block, 'part', 'PART_CORRECTION' FROM o WHERE fixed)
 SELECT code, level, count(*) AS n, sum(block)::BIGINT AS places FROM i GROUP BY code, level"""
)
def hierarchy_issues(spark, d):
    found = hi.heading_issues(_blocks(spark, d), _FIXES)
    return found.groupBy("code", "level").agg(F.count("*").alias("n"), F.sum("block").alias("places"))
