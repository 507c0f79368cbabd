"""Queries over page feeds, layout, models, reports and what a user does with an index, with the SQL that gives the same
rows. Pages are made from whole texts: a line of text is a line of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import sources
from ..checkpoints import remove, table_path
from ..functions import text as tx
from ..operators import feed as fe
from ..operators import incremental as inc
from ..operators import metrics as me
from ..operators import records as rec
from ..operators import reporting as rp
from ..operators import retrieval as ret
from .catalogue import _RULES, _SQL_ISSUES, _SQL_TOP, _hits, _metrics, _metrics_sql, _ranked, _records
from .registry import longs as _long
from .registry import query
from .registry import table as _t
from .storage import _letters, _versions

# --- the page feed ------------------------------------------------------------------------------------------------
# Eight lines of a text are a page in both languages: a marker (none on every fourth page), two lines of its row, a row with
# a heading and two lines, a heading outside the table and a line behind it. Some documents have a preamble, some a row
# before the first article.


def _page_lines(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("page", F.expr("i div 8 + 1")).withColumn("k", F.expr("i % 8"))
    own = own.withColumn("n", F.expr("page - page div 4")).withColumn("marker", F.expr("k = 0 AND page % 4 <> 0"))
    row, bold = F.expr("CASE WHEN k <= 2 THEN 0 WHEN k <= 5 THEN 1 END"), F.expr("marker OR k = 3 OR k = 6")
    en = F.expr("CASE WHEN marker AND page % 3 = 0 THEN 'Article ' || n || ' The x ' || t WHEN marker AND page % 5 = 0 THEN 'rticle ' || n WHEN marker THEN 'Article ' || n ELSE 'x ' || t END")
    ar = F.expr("CASE WHEN marker THEN 'مادة (' || n || ')' ELSE 'نص ' || t END")
    place = [F.col("doc_id").cast("string").alias("doc"), "page"]
    both = own.select(*place, F.lit("en").alias("lang"), F.col("k").alias("at"), en.alias("text"), bold.alias("bold"), row.alias("row"), (F.col("k") * 10.0).alias("y0"))
    both = both.unionByName(own.select(*place, F.lit("ar").alias("lang"), F.col("k").alias("at"), ar.alias("text"), (bold | (F.col("k") == 7)).alias("bold"), row.alias("row"), (F.col("k") * 10.0).alias("y0")))
    head = docs.select(F.col("doc_id"), F.explode(F.array(F.lit("en"), F.lit("ar"))).alias("lang")).select("*", F.explode(F.array(F.lit(-2), F.lit(-1))).alias("at")).where("(at = -2 AND doc_id % 4 = 0) OR (at = -1 AND doc_id % 3 = 1)")
    return both.unionByName(head.select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), "lang", "at", F.lit("نص").alias("text"), F.lit(False).alias("bold"), F.when(F.col("at") == -1, F.lit(-1)).alias("row"), (F.col("at") * 10.0).alias("y0")))


_SQL_PAGES = """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
 l AS (SELECT doc_id, i, t, i // 8 + 1 AS page, i % 8 AS k, (i // 8 + 1) - (i // 8 + 1) // 4 AS n, i % 8 = 0 AND (i // 8 + 1) % 4 <> 0 AS marker FROM o)"""


@query(
    _SQL_PAGES
    + """, x AS (SELECT 'en' AS lang, 'PREAMBLE' AS code FROM d WHERE doc_id % 4 = 0 UNION ALL SELECT 'ar', 'PREAMBLE' FROM d WHERE doc_id % 4 = 0
  UNION ALL SELECT 'en', 'TEXT_BEFORE_FIRST_ARTICLE' FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT 'ar', 'TEXT_BEFORE_FIRST_ARTICLE' FROM d WHERE doc_id % 3 = 1
  UNION ALL SELECT 'en', 'MARKER_GLUED' FROM l WHERE marker AND page % 3 = 0 UNION ALL SELECT 'en', 'MARKER_TYPO' FROM l WHERE marker AND page % 3 <> 0 AND page % 5 = 0
  UNION ALL SELECT 'en', 'ROW_WITHOUT_MARKER' FROM l WHERE k = 4 UNION ALL SELECT 'ar', 'AR_HEADING_UNPAIRED' FROM l WHERE k = 7
  UNION ALL SELECT NULL, 'PAGE_BREAK' FROM l WHERE k = 0 AND page % 4 = 0)
 SELECT lang, code, count(*) AS n FROM x GROUP BY ALL"""
)
def page_feed_issues(spark, d):
    return fe.fed(_page_lines(spark, d)).issues.groupBy("lang", "code").agg(F.count("*").alias("n"))


@query(
    _SQL_PAGES
    + """, e AS (SELECT doc_id, 'en' AS lang, n, i, CASE WHEN marker AND page % 3 = 0 THEN 'The x ' || t ELSE 'x ' || t END AS t FROM l WHERE k IN (1, 2, 4, 5, 7) OR (k = 0 AND (page % 3 = 0 OR NOT marker)) UNION ALL SELECT doc_id, 'ar', n, i, 'نص ' || t FROM l WHERE k IN (1, 2) OR (k = 0 AND NOT marker)),
 m AS (SELECT doc_id, lang, n, page FROM l, (SELECT unnest(['en', 'ar']) AS lang) WHERE marker) SELECT m.doc_id::VARCHAR AS doc, m.lang, m.n AS number, m.page, md5(coalesce(string_agg(t, chr(10) ORDER BY i), '')) AS digest FROM m LEFT JOIN e USING (doc_id, lang, n) GROUP BY ALL"""
)
def page_feed_articles(spark, d):
    made = fe.drafts(fe.fed(_page_lines(spark, d)))
    return made.select("doc", "lang", F.col("number").cast("long").alias("number"), F.col("page").cast("long").alias("page"), F.md5("text").alias("digest"))


@query("WITH g AS (SELECT l_orderkey AS page, l_linenumber AS k, min(l_quantity) * 2 AS x, min(l_discount) * 100 AS y FROM lineitem GROUP BY ALL), r AS (SELECT g.*, CASE WHEN y <= 2 THEN 0 WHEN y BETWEEN 4 AND 6 AND (x <= 30 OR x >= 60) THEN 1 WHEN y >= 8 THEN 2 END AS row FROM g) SELECT page, k, row, CASE WHEN row = 1 THEN CASE WHEN x <= 30 THEN 'en' ELSE 'ar' END WHEN x > 50 THEN 'ar' ELSE 'en' END AS lang FROM r")
def glyph_rows(spark, d):
    """Three rows of each page: of two cells, of three with an inner one that claims nothing, and a merged one."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k")).agg((F.min("l_quantity") * 2).cast("double").alias("x"), (F.min("l_discount") * 100).cast("double").alias("y"))
    boxes = [(0, 0, 0.0, 0.0, 50.0, 2.0), (0, 1, 50.0, 0.0, 100.0, 2.0), (1, 0, 0.0, 4.0, 30.0, 6.0), (1, 1, 30.0, 4.0, 60.0, 6.0), (1, 2, 60.0, 4.0, 100.0, 6.0), (2, 0, 0.0, 8.0, 100.0, 11.0)]
    cells = li.select("page").distinct().crossJoin(F.broadcast(spark.createDataFrame(boxes, "row long, cell int, x0 double, y0 double, x1 double, y1 double")))
    return rec.sided(li, cells, 50.0).select("page", "k", "row", "lang")


# --- text of the tables ---------------------------------------------------------------------------------------------

_AR_LETTERS = ("abcdefghijklmnopqrstuvwxyz0123456789", "أإآاىيبتثجحخدذرزسشصضطظعغَّ٠١٢٣٤٥٦٧٨٩")


@query(f"SELECT doc_id, md5(translate(replace(replace(translate(lower(text), '{_AR_LETTERS[0]}', '{_AR_LETTERS[1]}'), 'َ', ''), 'ّ', ''), 'أإآى', 'ااايي')) AS digest FROM documents".replace("'ااايي'", "'اااي'"))
def whole_texts_normalized(spark, d):
    """Whole texts in Arabic letters, with vowel marks and all forms of alef."""
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.normalize_ar(F.translate(F.lower("text"), *_AR_LETTERS))).alias("digest"))


_LINES_OF = "SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)"
_MARKED = "CASE i % 4 WHEN 0 THEN 'Article ' || i || ' ' || t WHEN 1 THEN 'rticle' || i WHEN 2 THEN 'مادة (' || i || ') ' || t ELSE 'see Article ' || i || ' ' || t END"


@query(f"WITH l AS ({_LINES_OF}) SELECT doc_id, i, CASE WHEN i % 4 = 0 AND regexp_matches(t, '^\\s*[A-Z(].') THEN i WHEN i % 4 = 1 OR (i % 4 = 2 AND length(t) > 0) OR (i % 4 = 2 AND t = '') OR (i % 4 = 0 AND FALSE) THEN i END AS number, CASE WHEN i % 4 = 0 AND regexp_matches(t, '^\\s*[A-Z(].') THEN md5(ltrim(t)) WHEN i % 4 = 2 AND ltrim(t) <> '' THEN md5(ltrim(t)) END AS rest FROM l WHERE trim(t) <> ''")
def markers_of_lines(spark, d):
    """Every line of every text, with a marker of one kind or another in front of it."""
    lines = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).where("trim(t) <> ''")
    return lines.select("doc_id", *_long("i"), tx.marker(F.expr(_MARKED)).alias("m")).select("doc_id", "i", F.col("m.number").cast("long").alias("number"), F.md5("m.rest").alias("rest"))


@query(f"WITH l AS ({_LINES_OF}) SELECT doc_id, i, CASE WHEN i % 3 > 0 THEN i END AS first, CASE WHEN i % 3 > 0 THEN i + 2 END AS last FROM l")
def repeals_of_lines(spark, d):
    lines = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    note = F.expr("CASE i % 3 WHEN 0 THEN 'Articles ' || i || ' and ' || (i + 2) || ' stay' WHEN 1 THEN '* Articles ' || i || '-' || (i + 2) || ' were repealed by ' || t ELSE 'Article ' || i || ' to ' || (i + 2) || ', REPEALED. ' || t END")
    return lines.select("doc_id", *_long("i"), tx.repeal_range(note).alias("r")).select("doc_id", "i", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


_UPPER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = "[" + ", ".join(f"'{w}'" for w in tx.SMALL_WORDS) + "]"


@query(
    rf"""WITH l AS ({_LINES_OF}), c AS (SELECT doc_id, i, replace(t, 'ß', 'ss') AS t FROM l WHERE trim(t) <> ''), r AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN translate(t, '{_UPPER[0]}', '{_UPPER[1]}') || ':' ELSE t || '. ' END AS c FROM c),
 x AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(c, '^\s+|\s+$', '', 'g'), '[:. ]+$', ''), '^\s+|\s+$', '', 'g') AS x FROM r)
 SELECT doc_id, i, md5(CASE WHEN x = upper(x) AND x <> lower(x) THEN array_to_string(list_transform(list_filter(string_split_regex(lower(x), '\s+'), lambda w: w <> ''), lambda w, k: CASE WHEN k > 1 AND list_contains({_SMALL}, w) THEN w ELSE upper(w[1]) || w[2:] END), ' ') ELSE x END) AS title FROM x"""
)
def titles_of_lines(spark, d):
    """Every line of every text as an English title, every other one in capitals."""
    lines = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).where("trim(t) <> ''").withColumn("t", F.replace("t", F.lit("ß"), F.lit("ss")))
    c = F.when(F.expr("i % 2 = 0"), F.concat(F.translate("t", *_UPPER), F.lit(":"))).otherwise(F.concat("t", F.lit(". ")))
    return lines.select("doc_id", *_long("i"), F.md5(tx.clean_title_en(c)).alias("title"))


_IN_ARABIC = ("abcdefghijklmnopqrstuvwxyz0123456789", "ابتثجحخدذرزسشصضطظعغفقكلمنه٠١٢٣٤٥٦٧٨٩")


@query(
    rf"""WITH l AS ({_LINES_OF}), a AS (SELECT doc_id, i, 'س' || translate(lower(t), '{_IN_ARABIC[0]}', '{_IN_ARABIC[1]}') AS a FROM l),
 t AS (SELECT doc_id, i, a, regexp_replace(regexp_replace('((' || a || ') :', '^\s+|\s+$', '', 'g'), '^[()]+|[()]+$', '', 'g') AS x FROM a)
 SELECT doc_id, i, md5(nullif(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[:.]+$', ''), '^\s+|\s+$', '', 'g'), '')) AS title, CASE i % 3 WHEN 0 THEN i WHEN 1 THEN i % 6 + 1 END AS number, md5(a) AS heading FROM t"""
)
def arabic_lines_of_texts(spark, d):
    """Every line of every text in Arabic letters, as a title in brackets and as a heading with a number or an ordinal."""
    lines = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    lines = lines.withColumn("a", F.concat(F.lit("س"), F.translate(F.lower("t"), *_IN_ARABIC)))
    word = F.element_at(F.array(*map(F.lit, tx.ORDINAL_PREFIXES)), F.expr("i % 6 + 1"))
    number = F.translate(F.col("i").cast("string"), "0123456789", tx.ARABIC_DIGITS)
    heading = F.when(F.expr("i % 3 = 0"), F.concat(number, F.lit(" - "), "a")).when(F.expr("i % 3 = 1"), F.concat(word, F.lit(":- "), "a")).otherwise(F.col("a"))
    made = lines.select("doc_id", *_long("i"), F.md5(tx.clean_title_ar(F.concat(F.lit("(("), "a", F.lit(") :")))).alias("title"), tx.ar_number(heading).alias("n"))
    return made.select("doc_id", "i", "title", F.col("n.number").cast("long").alias("number"), F.md5("n.title").alias("heading"))


# --- models, injected ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 3) AS a, round(v[6] / sqrt(list_dot_product(v, v)), 3) AS size FROM (SELECT doc_id, list_transform([length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, 'e', '')), length(t) - length(replace(t, 'i', '')), length(t) - length(replace(t, 'o', '')), length(t) - length(replace(t, 'u', '')), length(t)], lambda x: x::DOUBLE) AS v FROM (SELECT doc_id, 'ask: ' || coalesce(text, '') AS t FROM documents))")
def questions_embedded(spark, d):
    """Texts as questions of a model that has a prompt for them."""
    v = ret.embedded(_t(spark, d, "documents").select("doc_id", "text"), "text", "v", _letters, prompt="ask: ")
    return v.select("doc_id", F.round(F.get("v", F.lit(0)).cast("double"), 3).alias("a"), F.round(F.get("v", F.lit(5)).cast("double"), 3).alias("size"))


def _shorter(queries: list[str], texts: list[str]) -> list[float]:
    return [float(len(t) - len(q)) for q, t in zip(queries, texts, strict=True)]


@query("SELECT item_id, doc_id, (length(coalesce(d.text, '')) - length(b.text))::DOUBLE AS score FROM benchmark b JOIN documents d ON d.doc_id % 40 = item_id")
def pairs_scored(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    pairs = _t(spark, d, "documents").withColumn("item_id", F.expr("doc_id % 40")).join(b, "item_id")
    return ret.scored_pairs(pairs, "asked", "text", "score", _shorter).select("item_id", "doc_id", "score")


@query("SELECT conv_id, turn, md5(replace(text, 'e', 'E') || '!') AS answer FROM conversations")
def answers_generated(spark, d):
    c = rec.generated(_t(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "answer", lambda t: t.replace("e", "E") + "!")
    return c.select("conv_id", "turn", F.md5("answer").alias("answer"))


def _first_cited(message: str) -> str:
    """A stand-in for a model: it cites the first article that it is given, and one that it is not."""
    import re

    found = re.search(r"\[Article (\d+)\]", message)
    return f"As [Article {found[1]}] and [Article 99999] say." if found else "Nothing."


@query(_SQL_TOP + " SELECT q, min_by(id, rk) AS valid, 99999 AS invalid, 2 AS n FROM hits WHERE rk <= 3 GROUP BY q")
def answers_checked(spark, d):
    ranked, _ = _ranked(spark, d)
    texts = ranked.where("rk <= 3").select("q", "rk", F.col("id").alias("doc"), F.col("label").cast("string").alias("text"), F.lit(False).alias("is_repealed"))
    a = ret.answered(texts.select("q").distinct().withColumn("question", F.lit("What holds?")), texts, _first_cited)
    return a.select("q", F.get("valid", F.lit(0)).cast("long").alias("valid"), F.get("invalid", F.lit(0)).alias("invalid"), F.size("cited").alias("n"))


@query(f"SELECT 'whole' AS name, * FROM ({_metrics_sql(10)}) UNION ALL SELECT 'short', * FROM ({_metrics_sql(5)})")
def grid_metrics(spark, d):
    """The measures of a grid of two configurations."""
    return me.run_grid({"whole": {"depth": 10}, "short": {"depth": 5}}, lambda depth: _metrics(spark, d, depth))


# --- scores and totals -----------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT conv_id, turn, -turn / 4.0 - length(text) % 5 AS lp FROM conversations WHERE conv_id % 3 > 0), s AS (SELECT conv_id, coalesce(max(CASE WHEN turn % 2 = 0 THEN lp END), -20) - coalesce(max(CASE WHEN turn % 2 = 1 THEN lp END), -20) AS score FROM t GROUP BY 1) SELECT c.conv_id, round(coalesce(score, CASE WHEN c.conv_id % 2 = 0 THEN 4 ELSE -4 END), 4) AS score FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id)")
def judged_scores(spark, d):
    """Two thirds of the answers have captured tokens, the others are read by how they begin."""
    c = _t(spark, d, "conversations")
    tokens = c.where("conv_id % 3 > 0").select("conv_id", F.when(F.expr("turn % 2 = 0"), "yes").otherwise(" No").alias("token"), F.expr("-turn / 4.0D - length(text) % 5").alias("logprob"))
    answers = c.select("conv_id").distinct().withColumn("answer", F.expr("if(conv_id % 2 = 0, ' Yes, it is', 'Nothing')"))
    return me.judged_score(tokens, answers, "conv_id").select("conv_id", F.round("score", 4).alias("score"))


@query("SELECT event_type AS backend, (grouping(event_type))::INT AS whole, count(*) AS n, round(100 * avg((value > 50)::INT), 2) AS \"right\", count(CASE WHEN event_id % 6 = 0 THEN 1 END) AS invalid FROM events GROUP BY ROLLUP (event_type)")
def feedback_totals(spark, d):
    t = me.feedback_totals(_t(spark, d, "events"), "event_type", F.col("value") > 50, F.expr("event_id % 6 = 0"))
    return t.withColumn("whole", F.col("whole").cast("int"))


_SQL_BRAND_RUNS = "SELECT p_brand AS name, round(avg(p_size) / 50, 4) AS faithfulness, round(avg(p_retailprice), 4) AS recall FROM part GROUP BY 1"


def _brand_runs(spark, d) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size") / 50, 4).alias("faithfulness"), F.round(F.avg("p_retailprice"), 4).alias("recall"))


@query(f"WITH r AS ({_SQL_BRAND_RUNS}) SELECT name, faithfulness, round(faithfulness - (SELECT faithfulness FROM r WHERE name = 'Brand#11'), 4) AS delta FROM r")
def faithfulness_deltas(spark, d):
    return me.faithfulness_delta(_brand_runs(spark, d), "Brand#11")


@query("WITH s AS (SELECT source, CASE WHEN ('0x' || substr(md5('7-' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents) SELECT split, count(*) AS n, count(DISTINCT source) AS positives FROM s GROUP BY split")
def split_summary(spark, d):
    return inc.split_summary(inc.split(_t(spark, d, "documents"), "doc_id", 0.1, 7), "source")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 50 <> 0 ORDER BY md5('5-' || doc_id), doc_id LIMIT 20)")
def drawn_articles(spark, d):
    return inc.sample_sorted(_t(spark, d, "documents").where("doc_id % 50 <> 0").select("doc_id"), "doc_id", 20, 5)


# --- sources, reports, a user's day -------------------------------------------------------------------------------------


@query("SELECT item_id, text || '2' AS text, 'General' AS topic FROM benchmark")
def corpus_or_sample(spark, d):
    """The first of two files that is there: a JSON array in which every key comes twice, without topics."""
    path = table_path(spark, "corpus")
    rows = _t(spark, d, "benchmark").select("item_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("at"), "text").select("item_id", F.concat("text", "at").alias("text"), "at")
    array = rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "item_id", "text"))), lambda x: F.struct(x.item_id.alias("item_id"), x.text.alias("text")))).alias("value"))
    array.coalesce(1).write.text(path)
    return sources.first_readable(spark, [f"{path}-not-there", path], "item_id", "item_id long, text string").select("item_id", "text", "topic")


@query("SELECT doc_id AS name, CASE doc_id % 3 WHEN 0 THEN 'REPORT_MISSING' WHEN 1 THEN 'REPORT_STALE' ELSE 'TOO_LONG' END AS code FROM documents WHERE doc_id % 3 < 2 OR doc_id % 2 = 0")
def report_warnings(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("name"), "text")
    report = docs.where("name % 3 <> 0").select("name", F.sha2(F.when(F.expr("name % 3 = 1"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    issues = docs.select("name", F.expr("if(name % 4 = 3, 'info', 'warning')").alias("level"), F.expr("if(name % 2 = 0, 'TOO_LONG', 'TOO_SHORT')").alias("code"))
    return sources.report_warnings(docs, report, issues, spark.createDataFrame([("TOO_SHORT",)], "code string"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0")
def index_overwritten(spark, d):
    """An index is written twice; what is there in the end is counted."""
    path, docs = table_path(spark, "index"), _t(spark, d, "documents").select("doc_id", "text")
    sources.write_index(docs, path)
    sources.write_index(docs.where("doc_id % 2 = 0"), path)
    n = sources.row_count(spark, path)
    remove(spark, path)
    return spark.createDataFrame([(n,)], "n long") if sources.row_count(spark, path) is None else spark.createDataFrame([], "n long")


@query(_SQL_TOP + " SELECT 'absent' AS step, 0 AS found, (SELECT count(*) FROM q) AS added, 0 AS changed UNION ALL SELECT 'added', count(*), 0, 0 FROM q UNION ALL SELECT 'amended', 0, 0, count(*) FROM q")
def amended_index(spark, d):
    """Before and after (MIS-17): rows are missing and not found; once added each is its own nearest and a second run finds
    nothing to do; turned round they are changed, and each is its own nearest no longer."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked, text = e.where("id % 50 = 0"), lambda df: df.select("id", F.to_json("vector").alias("text"))
    step = lambda name, index, new: _step(name, index, new, asked, text)
    old = e.where("id % 50 <> 0")
    full = inc.merged(old, asked, "id")
    turned = asked.select("id", F.transform("vector", lambda x: -x).alias("vector"))
    return step("absent", old, asked).unionByName(step("added", full, asked)).unionByName(step("amended", inc.merged(full, turned, "id"), asked))


def _step(name: str, index: DataFrame, new: DataFrame, asked: DataFrame, text) -> DataFrame:
    first = ret.top_k(asked.withColumnRenamed("id", "q"), index, 1)
    found = first.agg(F.count(F.when(F.col("q") == F.col("id"), 1)).alias("found"))
    status = inc.classified(text(index), text(new), "id", "text").agg(F.count(F.when(F.col("status") == "added", 1)).alias("added"), F.count(F.when(F.col("status") == "changed", 1)).alias("changed"))
    return found.crossJoin(status).select(F.lit(name).alias("step"), *_long("found", "added", "changed"))


@query(_SQL_ISSUES + " SELECT code, count(*) AS n FROM i WHERE level = 'warning' GROUP BY code")
def console_warnings(spark, d):
    found = rec.issues(rec.with_marks(_records(spark, d)), "article_number", rec.record_rules(_RULES))
    return rp.warnings(found.groupBy("level", "code").agg(F.count("*").alias("n"))).select("code", "n")


@query(f"""WITH r AS ({_SQL_BRAND_RUNS}), c AS (SELECT row_number() OVER (ORDER BY name) + 1 AS "at", '| ' || name || ' | ' || CASE WHEN recall = (SELECT max(recall) FROM r) THEN '**' || printf('%.4f', recall) || '**' ELSE printf('%.4f', recall) END || ' | ' || printf('%.4f', faithfulness) || ' |' AS line FROM r)
 SELECT * FROM (SELECT 0 AS part, 0 AS "at", '# Runs' AS line UNION ALL SELECT 0, 1073741824, '' UNION ALL SELECT 1, 0, '| Run | recall | faithfulness |' UNION ALL SELECT 1, 1, '|---|---|---|' UNION ALL SELECT 1, "at", line FROM c UNION ALL SELECT 1, 1073741824, '')""")
def report_document(spark, d):
    runs = _brand_runs(spark, d)
    body = rp.table(runs, ["Run", "recall", "faithfulness"], [F.col("name"), rp.best("recall"), rp.shown("faithfulness")], [F.col("name")])
    return rp.document(rp.lines(spark, "# Runs"), body)


@query("SELECT count(*) AS articles, count(CASE WHEN doc_id % 50 = 0 THEN 1 END) AS repealed, count(DISTINCT CASE WHEN doc_id % 2 <> 0 THEN doc_id END) AS parts, count(*) AS issues FROM documents")
def corpus_json(spark, d):
    """The report of a corpus as one JSON object, read again; every record has one issue here."""
    r = _records(spark, d)
    issues = r.select(F.lit("info").alias("level"), F.lit("SEEN").alias("code"))
    j = rp.corpus_json(r, issues, ["part_number"])
    at = lambda p, kind="long": F.get_json_object("report", p).cast(kind)
    return j.select(at("$.articles").alias("articles"), at("$.repealed").alias("repealed"), at("$.hierarchy.part_number").alias("parts"), at("$.issues[0].n").alias("issues"))


@query(_SQL_TOP + ", f AS (SELECT q FROM q ORDER BY q LIMIT 3) SELECT q, id, rk FROM hits WHERE q IN (SELECT q FROM f)")
def first_questions(spark, d):
    """A run over the first questions alone (LIM-03)."""
    hits = _hits(spark, d)
    first = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q")).orderBy("q").limit(3)
    return hits.join(F.broadcast(first), "q", "left_semi").select("q", "id", *_long("rk"))


@query("WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 10000000, text FROM documents) SELECT length(text) AS size, count(*) AS n FROM v GROUP BY 1")
def sorted_sizes(spark, d):
    """Rows of a versioned table by size, in their order (SRT-01)."""
    return _versions(spark, d).read().groupBy(F.length("text").cast("long").alias("size")).agg(F.count("*").alias("n")).orderBy("size")


@query("SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events GROUP BY user_id")
def latest_of_each(spark, d):
    e = _t(spark, d, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return me.latest(e, "user_id", [F.desc("event_id")]).select("user_id", F.col("event_id").alias("latest")).join(n, "user_id").select("user_id", "n", "latest")
