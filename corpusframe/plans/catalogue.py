"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import sources, streaming
from ..functions import text as tx
from ..operators import incremental as inc
from ..operators import metrics as me
from ..operators import records as rec
from ..operators import retrieval as ret
from .registry import longs as _long
from .registry import query
from .registry import table as _t

# --- retrieval: vectors are the index, every one whose id 50 divides asks, an equal label is relevant --------------

_SQL_TOP = """WITH q AS (SELECT vec_id AS q, embedding AS v, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT q, ql, vec_id AS id, label, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 4) AS score FROM q JOIN embeddings ON vec_id <> q),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM s),
 hits AS (SELECT * FROM r WHERE rk <= 10)"""
_SQL_METRICS = (
    _SQL_TOP
    + """, n AS (SELECT q, count(*) AS total FROM q JOIN embeddings ON vec_id <> q AND label = ql GROUP BY q),
 p AS (SELECT q, min(CASE WHEN label = ql AND rk <= {depth} THEN rk END) AS first, count(CASE WHEN label = ql AND rk <= 5 THEN 1 END) AS h,
   sum(CASE WHEN label = ql AND rk <= 5 THEN 1 / log2(rk + 1.0) ELSE 0 END) AS g FROM hits GROUP BY q),
 m AS (SELECT n.q, CASE WHEN (n.q / 50)::BIGINT % 2 = 0 THEN 'ar' ELSE 'en' END AS lang, coalesce((first = 1)::INT, 0)::DOUBLE AS hit1, (coalesce(h, 0) > 0)::INT::DOUBLE AS hitk, coalesce(h, 0) / total AS recallk,
   coalesce(1.0 / first, 0) AS mrr, coalesce(g, 0) / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 1 + least(total, 5)) t(i)) AS ndcgk FROM n LEFT JOIN p USING (q))"""
)


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = _t(spark, d, "embeddings")
    index = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return ret.top_k(asked, index, k, skip_self=True)


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    hits = _hits(spark, d).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q")
    counts = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    total = e.where("vec_id % 50 = 0").join(counts, "label").select(F.col("vec_id").alias("q"), "n_relevant")
    return hits.withColumn("relevant", F.col("label") == F.col("ql")), total


def _lang(q: str = "q") -> Column:
    return F.when(F.expr(f"({q} div 50) % 2 = 0"), "ar").otherwise("en")


_MEASURES = ["hit1", "hitk", "recallk", "mrr", "ndcgk"]


@query(_SQL_TOP + " SELECT q, id, score, rk FROM hits")
def knn_topk(spark, d):
    return _hits(spark, d).select("q", "id", "score", *_long("rk"))


def _metrics_sql(depth: int) -> str:
    means = ", ".join(f"round(avg({m}), 4) AS {m}" for m in _MEASURES)
    return _SQL_METRICS.replace("{depth}", str(depth)) + f" SELECT coalesce(lang, 'all') AS part, count(*) AS n, {means} FROM m GROUP BY GROUPING SETS ((), (lang))"


def _metrics(spark, d, depth):
    ranked, total = _ranked(spark, d)
    return me.summary(me.ranking_metrics(ranked, total, 5, depth).withColumn("lang", _lang()), "lang", _MEASURES)


@query(_metrics_sql(10))
def retrieval_metrics(spark, d):
    return _metrics(spark, d, 10)


@query(_metrics_sql(5))
def retrieval_metrics_top5_depth(spark, d):
    return _metrics(spark, d, 5)


@query(_SQL_TOP + ", b AS (SELECT q, id // 4 AS doc, score, rk, row_number() OVER (PARTITION BY q, id // 4 ORDER BY rk) AS n FROM hits) SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY rk) AS rk FROM b WHERE n = 1")
def best_chunk_per_doc(spark, d):
    hits = _hits(spark, d).withColumn("doc", F.expr("id div 4"))
    return ret.best_per_document(hits).select("q", "doc", "score", *_long("rk"))


@query(
    _SQL_TOP
    + """, named AS (SELECT q, unnest([q + 1, q + 3]) AS doc, unnest([1, 2]) AS pos FROM q),
 u AS (SELECT q, doc, TRUE AS by_number, pos FROM named UNION ALL SELECT q, id, FALSE, rk FROM hits h WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.q = h.q AND n.doc = h.id)),
 o AS (SELECT q, doc, by_number, row_number() OVER (PARTITION BY q ORDER BY by_number DESC, pos) AS rk, sum(by_number::INT) OVER (PARTITION BY q) AS c FROM u)
 SELECT q, doc, by_number, rk FROM o WHERE rk <= greatest(5, c)"""
)
def hybrid_named_first(spark, d):
    hits = _hits(spark, d).withColumnRenamed("id", "doc")
    asked = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"))
    named = asked.select("q", F.posexplode(F.array(F.col("q") + 1, F.col("q") + 3)).alias("pos", "doc")).withColumn("pos", F.col("pos") + 1)
    return ret.merge_named(named, hits, 5).select("q", "doc", "by_number", *_long("rk"))


@query(_SQL_TOP + ", x AS (SELECT q, id, rk, (id * 37) % 11 AS second FROM hits), o AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY second DESC, rk) AS rk FROM x) SELECT q, id, rk FROM o WHERE rk <= 5")
def rerank_topk(spark, d):
    return ret.rerank(_hits(spark, d).withColumn("second", F.expr("(id * 37) % 11")), "second", 5).select("q", "id", *_long("rk"))


@query(_SQL_TOP + ", t AS (SELECT q // 100 AS pair, (q // 50) % 2 AS l, label AS doc FROM hits WHERE rk = 1), w AS (SELECT pair, max(CASE WHEN l = 0 THEN doc END) AS a, max(CASE WHEN l = 1 THEN doc END) AS e FROM t GROUP BY pair) SELECT round(avg((a = e)::INT), 4) AS rate, count(*) AS n FROM w WHERE a IS NOT NULL AND e IS NOT NULL")
def pair_agreement(spark, d):
    ranked, _ = _ranked(spark, d)
    return me.agreement(ranked.where("rk = 1").select(F.expr("q div 100").alias("pair"), _lang().alias("lang"), F.col("label").alias("doc")))


@query(_SQL_TOP + ", t AS (SELECT q % 3 = 0 AS inside, score FROM hits WHERE rk = 1) SELECT round(avg(CASE WHEN inside THEN score END), 4) AS in_scope, round(avg(CASE WHEN NOT inside THEN score END), 4) AS out_scope, round(avg(CASE WHEN inside THEN score END) - avg(CASE WHEN NOT inside THEN score END), 4) AS gap FROM t")
def scope_gap(spark, d):
    a, b = (F.avg(F.when(c, F.col("score"))) for c in (F.expr("q % 3 = 0"), F.expr("q % 3 <> 0")))
    return _hits(spark, d).where("rk = 1").agg(F.round(a, 4).alias("in_scope"), F.round(b, 4).alias("out_scope"), F.round(a - b, 4).alias("gap"))


_BUCKET = "CASE WHEN first = 1 THEN '1' WHEN first <= 5 THEN '2-5' WHEN first <= 10 THEN '6-10' ELSE 'miss' END"


@query(_SQL_TOP + f", f AS (SELECT q, min(CASE WHEN label = ql THEN rk END) AS first FROM hits GROUP BY q) SELECT {_BUCKET} AS bucket, count(*) AS n FROM f GROUP BY 1")
def rank_histogram(spark, d):
    ranked, _ = _ranked(spark, d)
    return ranked.groupBy("q").agg(F.min(F.when(F.col("relevant"), F.col("rk"))).alias("first")).groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


_SQL_RUNS = _SQL_TOP + ", a AS (SELECT q, min(CASE WHEN label = ql THEN rk END) AS first FROM hits GROUP BY q), o AS (SELECT q, label, ql, row_number() OVER (PARTITION BY q ORDER BY (id * 37) % 11 DESC, rk) AS rk FROM hits), b AS (SELECT q, min(CASE WHEN label = ql THEN rk END) AS first FROM o GROUP BY q)"


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    ranked, _ = _ranked(spark, d)
    other = ret.rerank(ranked.withColumn("second", F.expr("(id * 37) % 11")), "second", 10)
    first = lambda x: x.groupBy("q").agg(F.min(F.when(F.col("relevant"), F.col("rk"))).alias("first"))
    return first(ranked), first(other)


@query(_SQL_RUNS + " SELECT count(*) FILTER (coalesce(b.first <= 1, FALSE) AND NOT coalesce(a.first <= 1, FALSE)) AS won1, count(*) FILTER (coalesce(a.first <= 1, FALSE) AND NOT coalesce(b.first <= 1, FALSE)) AS lost1, count(*) FILTER (coalesce(b.first <= 5, FALSE) AND NOT coalesce(a.first <= 5, FALSE)) AS wonk, count(*) FILTER (coalesce(a.first <= 5, FALSE) AND NOT coalesce(b.first <= 5, FALSE)) AS lostk FROM a JOIN b USING (q)")
def run_won_lost(spark, d):
    base, run = _runs(spark, d)
    return me.won_lost(run, base, 5)


@query(_SQL_RUNS + " SELECT a.q, count(CASE WHEN b.first <= 5 THEN 1 END) AS n_other FROM a JOIN b USING (q) WHERE coalesce(a.first > 5, TRUE) GROUP BY a.q")
def baseline_misses_found_by(spark, d):
    base, run = _runs(spark, d)
    both = base.where("coalesce(first > 5, true)").select("q").join(run, "q")
    return both.groupBy("q").agg(F.count(F.when(F.col("first") <= 5, 1)).alias("n_other"))


_SQL_BY_BRAND = "SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS grid, round(avg(p_size), 2) AS recall, round(avg(p_retailprice), 2) AS hit1, max(p_size)::DOUBLE AS gap FROM part GROUP BY p_brand"


def _brands(spark, d) -> DataFrame:
    b = _t(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size"), 2).alias("recall"), F.round(F.avg("p_retailprice"), 2).alias("hit1"), F.max("p_size").cast("double").alias("gap"))
    return b.withColumn("grid", F.row_number().over(W.orderBy("name")).cast("long"))  # a run grid: one row a brand


@query(f"WITH r AS ({_SQL_BY_BRAND}) SELECT * FROM (SELECT 'recall' AS metric, max(recall) AS best FROM r UNION ALL SELECT 'hit1', max(hit1) FROM r UNION ALL SELECT 'gap', max(gap) FROM r)")
def best_per_metric(spark, d):
    b = _brands(spark, d)
    return b.agg(*(F.max(m).alias(m) for m in ("recall", "hit1", "gap"))).unpivot([], ["recall", "hit1", "gap"], "metric", "best")


@query(f"WITH r AS ({_SQL_BY_BRAND}), a AS (SELECT * FROM r WHERE recall = (SELECT max(recall) FROM r)), b AS (SELECT * FROM a WHERE hit1 >= (SELECT max(hit1) FROM a) - 1.0 / 58 - 1e-9) SELECT name, recall, hit1, gap, grid FROM b ORDER BY gap DESC, grid LIMIT 1")
def select_run(spark, d):
    return me.select_run(_brands(spark, d), 58).select("name", "recall", "hit1", "gap", "grid")


@query(_SQL_TOP + ", x AS (SELECT q, score * 10 AS t, ((id * 37) % 11) / 3.0 AS s FROM hits), e AS (SELECT q, exp(t - max(t) OVER (PARTITION BY q)) AS t, exp(s - max(s) OVER (PARTITION BY q)) AS s FROM x), p AS (SELECT q, t / sum(t) OVER (PARTITION BY q) AS t, s / sum(s) OVER (PARTITION BY q) AS s FROM e) SELECT q, round(sum(t * (ln(t) - ln(s))), 6) AS kl FROM p GROUP BY q")
def softmax_kl(spark, d):
    rows = _hits(spark, d).select("q", (F.col("score") * 10).alias("t"), (F.expr("(id * 37) % 11") / 3.0).alias("s"))
    return me.softmax_kl(rows, "q", "t", "s")


@query(_SQL_TOP + ", c AS (SELECT q, list(id ORDER BY rk)[1:5] AS c FROM hits GROUP BY q) SELECT q, array_to_string(CASE WHEN list_contains(c, q + 7) THEN c ELSE list_concat(c[1:4], [q + 7]) END, ',') AS cands, list_contains(c, q + 7) AS retrieved FROM c")
def force_positive(spark, d):
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))), lambda x: x.id)
    c = _hits(spark, d).where("rk <= 5").groupBy("q").agg(ranked.alias("c")).withColumn("p", F.col("q") + 7)
    return c.select("q", F.array_join(tx.force_positive("c", "p", 5).cast("array<string>"), ",").alias("cands"), F.array_contains("c", F.col("p")).alias("retrieved"))


# --- runs, logs, joins ---------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_run_per_name(spark, d):
    return me.latest(_t(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("latest"))


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def sql_count_join(spark, d):
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def feedback_tail(spark, d):
    return sources.last_rows(_t(spark, d, "events"), "event_id").select("event_id")


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 4) AS share FROM events GROUP BY event_type")
def feedback_stats(spark, d):
    return streaming.feedback_stats(_t(spark, d, "events"), "event_type", "value > 50")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(avg(value), 4) AS mean, round(max(value), 4) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return me.percentiles(_t(spark, d, "events"), "event_type", "value")


@query("WITH b AS (SELECT max(ts) - INTERVAL 6 HOUR AS t FROM events) SELECT count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS peak FROM events, b WHERE ts >= t")
def steady_window_stats(spark, d):
    e = _t(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 6 HOURS")).alias("t"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("t")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("peak"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return streaming.rates(_t(spark, d, "events"), "6 hours")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, range(0, 6) t(o) GROUP BY 1, 2")
def sliding(spark, d):
    return streaming.rates(_t(spark, d, "events"), "6 hours", "1 hour")


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, g")
def sessions(spark, d):
    return streaming.sessions(_t(spark, d, "events"), "2 hours")


@query("SELECT user_id, event_id, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'ok') AS b FROM (SELECT *, CASE WHEN value < 20 THEN 'firing' ELSE 'ok' END AS state FROM events)) WHERE state <> b")
def alert_transitions(spark, d):
    return me.alert_transitions(_t(spark, d, "events"), "user_id", "ts", "value", 20).select("user_id", "event_id", "state")


@query("SELECT count(*) AS n, count(s) AS judged, round(avg(s), 4) AS mean, count(s) >= 0.8 * count(*) AND coalesce(avg(s) >= 0.75, FALSE) AS passed FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality::DOUBLE END AS s FROM labels)")
def gate_decision(spark, d):
    failed = F.when(F.expr("doc_id % 11 = 0"), F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    return me.gate(_t(spark, d, "labels").withColumn("s", failed), "s", 0.75)


@query("SELECT w, stop, yes, tty, CASE WHEN w = 0 THEN 'go' WHEN stop THEN 'no' WHEN yes THEN 'go' WHEN NOT tty THEN 'no' ELSE 'ask' END AS go FROM (SELECT n_nationkey % 2 AS w, n_nationkey // 2 % 2 = 1 AS stop, n_nationkey // 4 % 2 = 1 AS yes, n_nationkey // 8 % 2 = 1 AS tty FROM nation)")
def gate_precedence(spark, d):
    bit = lambda i: F.expr(f"n_nationkey div {i} % 2 = 1")
    rows = _t(spark, d, "nation").select(F.expr("n_nationkey % 2").alias("w"), bit(2).alias("stop"), bit(4).alias("yes"), bit(8).alias("tty"))
    return rows.withColumn("go", inc.go_ahead("w", "stop", "yes", "tty"))


@query("SELECT p_partkey, greatest(1, least(floor((p_retailprice * 10 - 1000) / 2300)::INT, 4, p_size)) AS n FROM part")
def replica_plan(spark, d):
    return _t(spark, d, "part").select("p_partkey", inc.replicas(F.col("p_retailprice") * 10, F.lit(1000), F.lit(2300), 4, F.col("p_size")).alias("n"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, count(*) AS deltas FROM conversations GROUP BY conv_id")
def stream_replay(spark, d):
    return streaming.replayed(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"), "deltas")


@query("SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type")
def json_in_text(spark, d):
    inside = tx.json_inside(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" end")))
    return _t(spark, d, "events").select("event_type", F.from_json(inside, "k long").k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


# --- text ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ([,.;:!?])', '\\1', 'g')) AS digest FROM documents")
def doc_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.clean_en("text")).alias("digest"))


_MIXED = "text || repeat('ش', (length(text) * (doc_id % 5) // 4)::INT)"


@query(f"WITH t AS (SELECT doc_id, length(regexp_replace({_MIXED}, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace({_MIXED}, '[^\\p{{Lu}}]', '', 'g')) AS upper, (length(text) * (doc_id % 5) // 4)::INT AS arabic FROM documents) SELECT doc_id, letters, round(upper / greatest(1, letters), 4) AS upper_share, CASE WHEN letters > 0 AND 2 * arabic >= letters THEN 'ar' ELSE 'en' END AS lang FROM t")
def doc_language_share(spark, d):
    docs = _t(spark, d, "documents").withColumn("text", F.expr("text || repeat('ش', cast(length(text) * (doc_id % 5) div 4 AS int))"))
    n = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return docs.select("doc_id", n.cast("long").alias("letters"), F.round(F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), n), 4).alias("upper_share"), tx.question_language("text").alias("lang"))


_CITED = "text || ' [Article ' || (conv_id % 7) || '] ［Art. ' || (turn % 5) || '］ 【articles ' || (conv_id % 3) || '】 [Arts. ٤] [مادة 5] Article 6'"


@query("WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(" + _CITED + ", '(?i)[\\[【［]\\s*Art(?:icle)?s?\\.?\\s*([0-9٠-٩]+)\\s*[\\]】］]', 1), lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789')::INT) AS n FROM conversations), s AS (SELECT conv_id, turn, list_sort(list_distinct(n)) AS n FROM c) SELECT conv_id, turn, array_to_string(n, ',') AS cited, array_to_string(list_filter(n, lambda x: x IN (1, 2, 3)), ',') AS valid, array_to_string(list_filter(n, lambda x: x NOT IN (1, 2, 3)), ',') AS invalid FROM s")
def citation_check(spark, d):
    c = _t(spark, d, "conversations").withColumn("n", tx.extract_citations(F.expr(_CITED))).withColumn("ctx", F.array(F.lit(1), F.lit(2), F.lit(3)))
    joined = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ",")
    checked = c.withColumn("r", tx.citation_check("n", "ctx"))
    return checked.select("conv_id", "turn", joined(F.col("n")).alias("cited"), joined(F.col("r.valid")).alias("valid"), joined(F.col("r.invalid")).alias("invalid"))


_ASKED = "'What do Article ' || (doc_id % 50) || ' and articles  ' || n_chars || ' and المادة رقم ' || translate((doc_id % 90)::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' say of art. 77? ' || text"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all({_ASKED}, '(?i)\\barticles?\\s+([0-9]{{1,4}})\\b', 1), regexp_extract_all({_ASKED}, '(?:المادة|مادة|المواد)\\s*(?:رقم\\s*)?[(]?\\s*([0-9٠-٩]{{1,4}})', 1)), lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789')::INT), lambda x: x BETWEEN 10 AND 2000))), ',') AS numbers FROM documents")
def numbers_in_text(spark, d):
    q = F.expr(_ASKED.replace("::VARCHAR", "::STRING"))
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(tx.numbers_in_question(q, 10, 2000)).cast("array<string>"), ",").alias("numbers"))


@query("SELECT c_custkey, 'Part ' || r_regionkey || ' ' || r_name || ' > Book ' || n_nationkey || ' ' || n_name || ' > ' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def heading_path(spark, d):
    t = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select("c_custkey", tx.heading_path([("Part", "r_regionkey", "r_name"), ("Book", "n_nationkey", "n_name"), ("", "c_custkey", "c_mktsegment")]).alias("path"))


@query("WITH t AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT 'r_name' AS level, count(DISTINCT r_name) AS n FROM t UNION ALL SELECT 'n_name', count(DISTINCT (r_name, n_name)) FROM t UNION ALL SELECT 'c_mktsegment', count(DISTINCT (r_name, n_name, c_mktsegment)) FROM t")
def hierarchy_cardinality(spark, d):
    t = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rec.cardinalities(t, ["r_name", "n_name", "c_mktsegment"])


@query("""WITH l AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 1 THEN l_partkey END AS a, CASE WHEN l_linenumber = 3 THEN l_partkey END AS b FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
 f AS (SELECT doc, pos, max(CASE WHEN a IS NOT NULL THEN pos END) OVER w AS pa, max(CASE WHEN b IS NOT NULL THEN pos END) OVER w AS pb, last_value(a IGNORE NULLS) OVER w AS va, last_value(b IGNORE NULLS) OVER w AS vb FROM l WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))
 SELECT doc, pos, va AS a, CASE WHEN pb > coalesce(pa, -1) THEN vb END AS b FROM f""")
def hierarchy_fill_reset(spark, d):
    at = lambda n: F.when(F.col("l_linenumber") == n, F.col("l_partkey"))
    lines = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = lines.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), at(1).alias("a"), at(3).alias("b"))
    return rec.filled(rows, "doc", "pos", ["a", "b"])


# --- data quality ----------------------------------------------------------------------------------------


@query("WITH m AS (SELECT n FROM (SELECT unnest(range(0, max(doc_id) + 1)) AS n FROM documents) WHERE n NOT IN (SELECT doc_id FROM documents WHERE md5(doc_id::VARCHAR) > '2')), i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM m) SELECT min(n) AS first, max(n) AS last FROM i GROUP BY g")
def dq_numbering(spark, d):
    docs = _t(spark, d, "documents")
    last = docs.agg(F.max("doc_id")).collect()[0][0]
    return rec.numbering_gaps(docs.where(F.md5(F.col("doc_id").cast("string")) > "2").select(F.col("doc_id").alias("n")), 0, last)


#: Records of documents: the other language is the whole text letter for letter, backwards in every seventh.
_LATIN, _OTHER = "abcdefghijklmnopqrstuvwxyz0123456789,", "ابتثجحخدذرزسشصضطظعغفقكلمنه٠١٢٣٤٥٦٧٨٩،"


def _records(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    other = F.translate(F.lower(F.when(F.expr("doc_id % 7 = 3"), F.reverse(text)).otherwise(text)), _LATIN, _OTHER)
    level = lambda i: F.when(F.expr(f"doc_id % {i + 2} <> 0"), F.col("doc_id")).alias(f"{rec.NUMBERED_LEVELS[i]}_number")
    title = lambda i: F.when(F.expr(f"doc_id % {i + 11} <> 0"), F.col("source")).alias(f"{rec.NUMBERED_LEVELS[i]}_title_en")
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("article_number"),
        F.expr("if(doc_id % 13 = 0, null, doc_id + if(doc_id % 17 = 0, 1, 0))").alias("ar_number"),
        F.when(F.expr("doc_id % 9 <> 0"), text).otherwise("").alias("text_en"),
        F.when(F.expr("doc_id % 8 <> 0"), other).otherwise("").alias("text_ar"),
        F.expr("doc_id % 50 = 0").alias("is_repealed"),
        F.expr("if(doc_id % 100 = 0, 'note', null)").alias("repeal_note"),
        F.expr("if(doc_id % 5 = 0, array(1, 2), array(1))").alias("source_pages"),
        *(f(i) for i in range(5) for f in (level, title)),
    )


_RULES = {"min_chars": 60, "max_chars": 6000, "ratio": (0.35, 1.6)}


def _sql_issues() -> str:
    mark = lambda c, p, digits=False: f"regexp_extract_all({c}, '(?m){p}', 1)"
    western = lambda c: f"translate({c}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
    numbers = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: ltrim(x, '0')))"
    unordered = lambda x: f"len({x}) > 0 AND {x} <> list_transform(range(1, len({x}) + 1), lambda i: i::VARCHAR)"
    quoted = lambda p: p.replace("'", "''")
    rules = {
        "EMPTY_TEXT_EN": "en = ''", "EMPTY_TEXT_AR": "ar = ''", "AR_NUMBER_MISSING": "arn IS NULL", "AR_NUMBER_MISMATCH": "arn <> k",
        "CUT_OFF_EN": "open_en AND (pages > 1 OR right(en, 1) IN (',', '-'))", "CUT_OFF_AR": "open_ar AND (pages > 1 OR right(ar, 1) IN ('،', ',', '-'))",
        "NO_FINAL_PERIOD_EN": "open_en AND NOT (pages > 1 OR right(en, 1) IN (',', '-'))", "NO_FINAL_PERIOD_AR": "open_ar AND NOT (pages > 1 OR right(ar, 1) IN ('،', ',', '-'))",
        "TOO_SHORT": "en <> '' AND ar <> '' AND least(length(ar), length(en)) < 60", "TOO_LONG": "length(ar) + length(en) > 6000",
        "LENGTH_RATIO": "en <> '' AND ar <> '' AND (length(ar) / length(en) < 0.35 OR length(ar) / length(en) > 1.6)",
        "PARAGRAPH_SEQUENCE": unordered("paras"), "LIST_SEQUENCE_AR": unordered("la"), "LIST_SEQUENCE_EN": unordered("le"),
        "LIST_COUNT_MISMATCH": "na > 0 AND ne > 0 AND na <> ne", "LIST_FORMAT_DIFFERS": "(na = 0 OR ne = 0) AND na <> ne",
        "ARTIFACT_PRESENTATION_FORMS": f"regexp_matches(ar, '{rec.PRESENTATION_FORMS}')", "ARTIFACT_PRIVATE_GLYPH": f"regexp_matches(ar || en, '{rec.PRIVATE_USE}')",
        "ARTIFACT_LIGATURE": f"regexp_matches(ar, '{rec.LIGATURE_BUG}')", "ARTIFACT_BRACKETS": f"regexp_matches(ar, '{rec.STRAY_BRACKETS}')",
        "LATIN_IN_ARABIC": "regexp_matches(ar, '[A-Za-z]')", "ARABIC_IN_ENGLISH": "regexp_matches(en, '[ء-ي]')",
        "PARENS_UNBALANCED_EN": "length(replace(en, '(', '')) <> length(replace(en, ')', ''))", "NO_HIERARCHY": "k % 5 = 0 AND k % 4 = 0",
    }
    infos = ("NO_FINAL_PERIOD_EN", "NO_FINAL_PERIOD_AR", "LIST_FORMAT_DIFFERS", "PARENS_UNBALANCED_EN")
    parts = [f"SELECT k, '{'info' if code in infos else 'warning'}' AS level, '{code}' AS code FROM p WHERE NOT rep AND {test}" for code, test in rules.items()]
    parts += [f"SELECT k, 'warning', 'HEADING_NO_TITLE' FROM p WHERE NOT rep AND k % {i + 2} <> 0 AND (k % {i + 11} = 0 OR source IS NULL OR source = '')" for i in range(5)]
    parts += ["SELECT k, 'warning', 'REPEALED_HAS_TEXT' FROM p WHERE rep AND (en <> '' OR ar <> '')", "SELECT k, 'warning', 'REPEALED_NO_NOTE' FROM p WHERE rep AND k % 100 <> 0"]
    turned = "list_filter(numbers_ar, lambda x: len(x) > 1 AND NOT list_contains(numbers_en, x) AND ltrim(reverse(x), '0') <> x AND list_contains(numbers_en, ltrim(reverse(x), '0')))"
    parts.append(f"SELECT k, 'warning', 'NUMBER_REVERSED' FROM (SELECT k, unnest(list_distinct(list_transform({turned}, lambda x: ltrim(reverse(x), '0')))) FROM p WHERE NOT rep)")
    letters = f"list_transform({mark('ar', rec.AR_LETTER)}, lambda x: instr('{rec.ABJAD}', x)::VARCHAR)"
    return f"""WITH t AS (SELECT doc_id AS k, source, coalesce(text, '') AS text FROM documents),
 r AS (SELECT k, source, CASE WHEN k % 9 <> 0 THEN text ELSE '' END AS en, CASE WHEN k % 8 <> 0 THEN translate(lower(CASE WHEN k % 7 = 3 THEN reverse(text) ELSE text END), '{_LATIN}', '{_OTHER}') ELSE '' END AS ar,
  k % 50 = 0 AS rep, CASE WHEN k % 13 <> 0 THEN k + (k % 17 = 0)::INT END AS arn, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS pages FROM t),
 p AS (SELECT *, en <> '' AND NOT regexp_matches(en, '{quoted(rec.TERMINAL["en"])}') AS open_en, ar <> '' AND NOT regexp_matches(ar, '{rec.TERMINAL["ar"]}') AS open_ar,
  list_transform({mark("ar", rec.AR_PARAGRAPH)}, lambda x: ltrim({western("x")}, '0')) AS paras, {letters} AS la, list_transform({mark("en", rec.EN_LETTER)}, lambda x: (ascii(x) - 96)::VARCHAR) AS le,
  len({mark("ar", rec.AR_LETTER)}) + len({mark("ar", rec.AR_ITEM)}) AS na, len({mark("en", rec.EN_LETTER)}) + len({mark("en", rec.EN_ITEM)}) AS ne, {numbers("en")} AS numbers_en,
  {numbers(western(f"regexp_replace(translate(ar, '0123456789', '          '), '(?m){rec.AR_PARAGRAPH}', '', 'g')"))} AS numbers_ar FROM r),
 i AS ({" UNION ALL ".join(parts)})"""


_SQL_ISSUES = _sql_issues()


@query(_SQL_ISSUES + " SELECT k AS article_number, level, code FROM i")
def dq_record_rules(spark, d):
    return rec.issues(rec.with_marks(_records(spark, d)), "article_number", rec.record_rules(_RULES)).select("article_number", "level", "code")


@query(_SQL_ISSUES + ", n AS (SELECT *, row_number() OVER (PARTITION BY level, code ORDER BY k) AS n FROM i) SELECT level, code, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (n <= 3) AS examples FROM n GROUP BY level, code")
def dq_issue_summary(spark, d):
    return rec.issue_summary(rec.issues(rec.with_marks(_records(spark, d)), "article_number", rec.record_rules(_RULES)), "article_number")


@query("SELECT l_orderkey AS id, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS ok FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey")
def dq_list_sequence(spark, d):
    rows = _t(spark, d, "lineitem").where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))
    return rows.select("id", tx.in_sequence("s").alias("ok"))


@query("SELECT p_partkey, 'p_name' AS \"column\", CASE WHEN p_partkey % 10 = 0 THEN 'GOLDEN_MISMATCH' ELSE 'GOLDEN_PARAGRAPHS' END AS code FROM part WHERE p_partkey % 10 IN (0, 1) UNION ALL SELECT p_partkey, 'p_size', 'GOLDEN_MISMATCH' FROM part WHERE p_partkey % 15 = 0 UNION ALL SELECT p_partkey, 'p_type', 'GOLDEN_MISMATCH' FROM part WHERE p_partkey % 9 = 0")
def golden_diff(spark, d):
    p = _t(spark, d, "part")
    name = F.expr("CASE p_partkey % 10 WHEN 0 THEN p_name || 'x' WHEN 1 THEN p_name || '\n' WHEN 2 THEN null ELSE ' ' || p_name END")
    moved = p.withColumn("p_name", name).withColumn("p_size", F.expr("p_size + if(p_partkey % 15 = 0, 1, 0)")).withColumn("p_type", F.expr("if(p_partkey % 9 = 0, p_type || ' ', p_type)"))
    return rec.golden_diff(p, moved, "p_partkey", ["p_name", "p_brand", "p_size", "p_type"], ["p_name"])


@query("WITH e AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT DISTINCT l_orderkey AS n FROM lineitem WHERE l_orderkey % 4 <> 0), t AS (SELECT c_custkey AS n FROM customer) SELECT n, CASE WHEN e.n IS NOT NULL THEN 'en' WHEN a.n IS NOT NULL THEN 'ar' ELSE 'note' END AS source, t.n IS NOT NULL AS is_repealed FROM e FULL JOIN a USING (n) FULL JOIN t USING (n)")
def full_outer_assemble(spark, d):
    en = _t(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("text"))
    ar = _t(spark, d, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("n")).distinct().withColumn("text", F.lit("x"))
    return rec.assembled(en, ar, _t(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("text"))).select("n", "source", "is_repealed")


@query("SELECT l_orderkey AS k, array_to_string(list_sort(list(DISTINCT month(l_shipdate))), ',') AS pages, count(DISTINCT month(l_shipdate)) - 1 AS breaks FROM lineitem GROUP BY l_orderkey")
def page_spans(spark, d):
    s = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.month("l_shipdate"))).alias("p"))
    return s.select("k", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"), (F.size("p") - 1).cast("long").alias("breaks"))


@query("SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND b.c_acctbal BETWEEN a.s_acctbal - 40 AND a.s_acctbal + 40")
def band_join_y(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    # rounding keeps order, so that what lies between two sums lies in a step between theirs
    s = s.withColumn("step", F.explode(F.expr("sequence(floor((s_acctbal - 40) / 40), floor((s_acctbal + 40) / 40))")))
    c = c.withColumn("c_step", F.expr("floor(c_acctbal / 40)"))
    met = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("step") == F.col("c_step")))
    return met.where("c_acctbal BETWEEN s_acctbal - 40 AND s_acctbal + 40").select(F.col("s_suppkey").alias("a"), F.col("c_custkey").alias("b"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey AS page, l_linenumber AS k, l_quantity AS x, l_discount * 100 AS y FROM l), c AS (SELECT l_orderkey AS page, l_linenumber AS cell, l_quantity - 5 AS x0, l_quantity + 5 AS x1, 0.0 AS y0, 6.0 AS y1 FROM l) SELECT g.page, g.k, min(cell) AS cell FROM g LEFT JOIN c ON g.page = c.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY g.page, g.k")
def first_claim(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_discount").alias("l_discount"))
    glyphs = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    cells = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("cell"), (F.col("l_quantity") - 5).alias("x0"), (F.col("l_quantity") + 5).alias("x1"), F.lit(0.0).alias("y0"), F.lit(6.0).alias("y1"))
    return rec.claimed(glyphs, cells).select("page", "k", "cell")


# --- chunks and maintenance ------------------------------------------------------------------------------

_SQL_WINDOWS = """WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+\\s*') AS t FROM documents), n AS (SELECT *, len(t) AS n FROM t),
 s AS (SELECT doc_id, text, t, n, unnest(CASE WHEN n <= 40 THEN [0] ELSE list_filter(range(0, n + 1, 35), lambda s: s = 0 OR s + 5 < n) END) AS s FROM n)
 SELECT doc_id, s // 35 AS w, least(40, n - s) AS n_tokens, md5(CASE WHEN n <= 40 THEN text ELSE regexp_replace(array_to_string(t[s + 1:s + 40], ''), '\\s+$', '') END) AS digest FROM s"""


@query(_SQL_WINDOWS)
def chunk_windows(spark, d):
    w = rec.windows(_t(spark, d, "documents"), "doc_id", "text", 40, 5)
    return w.select("doc_id", *_long("w", "n_tokens"), F.md5("chunk").alias("digest"))


def _articles(spark, d) -> DataFrame:
    """Whole bilingual records from documents."""
    levels = {f"{x}_{p}": F.lit(None).cast("int" if p == "number" else "string") for x in rec.NUMBERED_LEVELS for p in ("number", "title_en", "title_ar")}
    levels |= {"part_number": F.expr("cast(nullif(doc_id % 12, 0) AS int)"), "part_title_en": F.col("source"), "part_title_ar": F.expr("if(doc_id % 4 <> 0, 'عنوان', null)"), "topic_title_en": F.expr("if(doc_id % 3 = 0, lang, null)"), "subtopic_title_en": F.expr("if(doc_id % 5 = 0, 'Sub', null)"), "subtopic_title_ar": F.expr("if(doc_id % 10 = 0, 'فرع', null)")}
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("article_number"),
        *(c.alias(n) for n, c in levels.items()),
        F.col("text").alias("text_en"),
        F.concat(F.lit("أَحكام "), F.col("lang")).alias("text_ar"),
        F.expr("doc_id % 50 = 0").alias("is_repealed"),
        F.concat(F.lit("note "), F.col("doc_id")).alias("repeal_note"),
        F.lit(None).cast("string").alias("repeal_note_ar"),
        F.concat(F.lit("Art. "), F.col("doc_id")).alias("citation"),
        F.expr("array(doc_id % 7, doc_id % 7 + 1)").alias("source_pages"),
    )


_SPELLED = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(tx.ORDINALS_AR, 1)) + " ELSE (doc_id % 12)::VARCHAR END"
_SQL_ARTICLES = f"""WITH h AS (SELECT *, concat_ws(' > ', CASE WHEN doc_id % 12 <> 0 THEN concat_ws(' | ', 'Part ' || doc_id % 12 || ' ' || source, concat_ws(' ', 'القسم', {_SPELLED}, CASE WHEN doc_id % 4 <> 0 THEN 'عنوان' END)) ELSE concat_ws(' | ', source, CASE WHEN doc_id % 4 <> 0 THEN 'عنوان' END) END,
   CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 10 = 0 THEN 'Sub | فرع' WHEN doc_id % 5 = 0 THEN 'Sub' END) || chr(10) || 'Article ' || doc_id || ' | مادة ' || doc_id || CASE WHEN doc_id % 50 = 0 THEN ' (repealed | ملغاة)' ELSE '' END AS header,
  printf('art-%04d', doc_id) AS id, doc_id % 50 = 0 AS rep, 'أَحكام ' || lang AS ar, nullif(text, '') AS en FROM documents)"""
_SQL_PLAIN = "translate(replace(t, 'َ', ''), 'أ', 'ا')"


@query(_SQL_ARTICLES + f", c AS (SELECT id, concat_ws(chr(10), header, CASE WHEN rep THEN 'note ' || doc_id ELSE concat_ws(chr(10), ar, en) END) AS t, 10 + 2 * (doc_id % 12 <> 0)::INT FROM h) SELECT id, md5(t) AS digest, md5({_SQL_PLAIN}) AS embedded FROM c")
def chunk_whole(spark, d):
    return rec.chunked(_articles(spark, d), "article", normalize=True).select("id", F.md5("text").alias("digest"), F.md5("embed_text").alias("embedded"))


@query(_SQL_ARTICLES + " SELECT id, md5(header || chr(10) || 'note ' || doc_id) AS digest, NULL AS lang FROM h WHERE rep UNION ALL SELECT id || '-ar', md5(header || chr(10) || ar), 'ar' FROM h WHERE NOT rep UNION ALL SELECT id || '-en', md5(concat_ws(chr(10), header, en)), 'en' FROM h WHERE NOT rep")
def chunk_per_lang(spark, d):
    return rec.chunked(_articles(spark, d), "per_language").select("id", F.md5("text").alias("digest"), F.try_element_at("metadata", F.lit("lang")).alias("lang"))


@query(
    _SQL_ARTICLES
    + r""", b AS (SELECT *, CASE WHEN rep THEN 'note ' || doc_id ELSE concat_ws(chr(10), ar, en) END AS body FROM h), t AS (SELECT *, regexp_extract_all(body, '\S+\s*') AS t, greatest(60 - (len(regexp_extract_all(header, '\S+')) + 1), 21) AS room FROM b),
 s AS (SELECT *, unnest(starts) AS s, len(starts) AS k FROM (SELECT *, CASE WHEN len(t) <= room THEN [0] ELSE list_filter(range(0, len(t) + 1, room - 5), lambda s: s = 0 OR s + 5 < len(t)) END AS starts FROM t))
 SELECT id || CASE WHEN k > 1 THEN printf('-w%02d', (s // (room - 5))::INT) ELSE '' END AS id, md5(header || chr(10) || CASE WHEN k = 1 THEN body ELSE regexp_replace(array_to_string(t[s + 1:s + room], ''), '\s+$', '') END) AS digest FROM s"""
)
def chunk_record_windows(spark, d):
    return rec.chunked(_articles(spark, d), "window", 60, 5).select("id", F.md5("text").alias("digest"))


@query("SELECT printf('art-%04d', doc_id) AS id, doc_id::VARCHAR AS number, CASE WHEN doc_id % 50 = 0 THEN 'true' ELSE 'false' END AS repealed, (doc_id % 7) || ',' || (doc_id % 7 + 1) AS pages, CASE WHEN doc_id % 12 <> 0 THEN (doc_id % 12)::VARCHAR END AS part, 4 + (doc_id % 12 <> 0)::INT + (source IS NOT NULL)::INT + (doc_id % 4 <> 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 10 = 0)::INT AS n FROM documents")
def chunk_metadata(spark, d):
    m = rec.chunked(_articles(spark, d), "article")
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    return m.select("id", at("article_number").alias("number"), at("is_repealed").alias("repealed"), at("source_pages").alias("pages"), at("part_number").alias("part"), F.size("metadata").alias("n"))


@query("SELECT sum(n)::BIGINT AS total, median(n) AS middle, max(n) AS most, count(CASE WHEN n > 1000 THEN 1 END) AS too_long FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def token_stats(spark, d):
    n = _t(spark, d, "documents").select(F.size(tx.tokens("text")).cast("long").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.median("n").alias("middle"), F.max("n").alias("most"), F.count(F.when(F.col("n") > 1000, 1)).alias("too_long"))


def _old(spark, d) -> DataFrame:
    return _t(spark, d, "documents").where("doc_id % 3 <> 0").withColumn("text", F.when(F.expr("doc_id % 5 = 0"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))).select("doc_id", "text")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")
def change_classify(spark, d):
    new = _t(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", "text")
    return inc.classified(_old(spark, d), new, "doc_id", "text").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 7 <> 0 THEN text || '2' WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS digest FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 3 <> 0 UNION ALL SELECT NULL, md5('new')")
def merge_upsert(spark, d):
    """Every new row twice, the later one counts; both sides have a row without a key."""
    docs = _t(spark, d, "documents").where("doc_id % 7 <> 0")
    new = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "text").select("doc_id", F.concat("text", F.col("at").cast("string")).alias("text"), "at")
    one = lambda text, *more: spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), *more)
    return inc.merged(_old(spark, d).union(one("old")), new.union(one("new", F.lit(1))), "doc_id", "at").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def heldout_anti(spark, d):
    evaluation = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return inc.held_out(_t(spark, d, "documents"), evaluation, "doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('7-' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, d):
    return inc.split(_t(spark, d, "documents"), "doc_id", 0.1, 7).select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5('3-' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return inc.sample(_t(spark, d, "documents").select("doc_id"), "doc_id", 50, 3)


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', doc_id::VARCHAR, source, text)), 'license')")
def search_substring(spark, d):
    return _t(spark, d, "documents").where(F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "text")).contains("license")).select("doc_id")


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a ')) AS links FROM pages")
def page_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<a ")).cast("long").alias("links"))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(DISTINCT text) AS texts, min(length(text)) AS shortest FROM benchmark")
def eval_set_checks(spark, d):
    return _t(spark, d, "benchmark").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("ids"), F.count_distinct("text").alias("texts"), F.min(F.length("text")).cast("long").alias("shortest"))


@query("SELECT n_nationkey || '-name' AS id, n_name AS value FROM nation UNION ALL SELECT n_nationkey || '-region', n_regionkey::VARCHAR FROM nation")
def unpivot_topics(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return n.unpivot(["n_nationkey"], ["name", "region"], "part", "value").select(F.concat_ws("-", F.col("n_nationkey").cast("string"), "part").alias("id"), "value")


@query("SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM documents) AS records, (SELECT count(*) FROM embeddings) <> (SELECT count(*) FROM documents) AS stale, (SELECT count(*) FROM embeddings) >= (SELECT count(*) FROM documents) AS usable")
def index_status(spark, d):
    return inc.status(_t(spark, d, "embeddings"), _t(spark, d, "documents"))


@query("SELECT c_custkey, CASE r WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 14 ELSE 40 END AS n FROM (SELECT c_custkey, c_nationkey % 5 AS r FROM customer)")
def roman_numbers(spark, d):
    names = F.element_at(F.array(*map(F.lit, ["I", "IV", "IX", "XIV", "XL"])), F.expr("c_nationkey % 5 + 1"))
    return _t(spark, d, "customer").select("c_custkey", tx.roman_to_int(names).alias("n"))


@query("SELECT n_nationkey, regexp_replace(regexp_replace(regexp_replace(lower(n_name || ' /Model_3 v1.0 '), '^.*/', ''), '[^a-z0-9._-]', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug FROM nation")
def collection_slug(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", tx.slug(F.concat("n_name", F.lit(" /Model_3 v1.0 "))).alias("slug"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


# --- prompts, checks of markers, reports -----------------------------------------------------------------


@query(_SQL_TOP + " SELECT q, md5(string_agg('[Article ' || id || ']' || CASE WHEN id % 10 = 0 THEN ' (REPEALED)' ELSE '' END || chr(10) || label, chr(10) || chr(10) ORDER BY rk)) AS digest FROM hits WHERE rk <= 5 GROUP BY q")
def prompt_assembly(spark, d):
    ranked, _ = _ranked(spark, d)
    texts = ranked.where("rk <= 5").select("q", "rk", F.col("id").alias("doc"), F.col("label").cast("string").alias("text"), F.expr("id % 10 = 0").alias("is_repealed"))
    return ret.prompts(texts).select("q", F.md5("context").alias("digest"))


@query("WITH t AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS token, -turn / 4.0 - length(text) % 5 AS lp FROM conversations) SELECT conv_id, round(coalesce(max(CASE WHEN token = 'yes' THEN lp END), -20) - coalesce(max(CASE WHEN token = 'no' THEN lp END), -20), 4) AS score FROM t GROUP BY conv_id")
def yes_no_score(spark, d):
    said = F.when(F.expr("turn % 2 = 0"), " Yes").otherwise("NO ")
    rows = _t(spark, d, "conversations").select("conv_id", said.alias("token"), F.expr("-turn / 4.0D - length(text) % 5").alias("logprob"))
    return me.yes_no_score(rows, "conv_id").select("conv_id", F.round("score", 4).alias("score"))


@query("SELECT a.l_orderkey AS n, a.p AS en_at, b.p AS ar_at FROM (SELECT l_orderkey, min(l_suppkey) AS p FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) b USING (l_orderkey) WHERE a.p <> b.p")
def marker_crosscheck(spark, d):
    at = lambda c: _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("n")).agg(F.min(c).alias("at"))
    return rec.row_mismatches(at("l_suppkey"), at("l_partkey"))


@query("WITH f AS (SELECT l_suppkey, l_linestatus, min(CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) AS first FROM lineitem GROUP BY ALL) SELECT l_suppkey AS doc, l_linestatus AS lang, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem JOIN f USING (l_suppkey, l_linestatus) WHERE l_orderkey * 10 + l_linenumber >= f.first GROUP BY ALL")
def preamble_skipped(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linestatus").alias("lang"), F.expr("l_orderkey * 10 + l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", 1).alias("row"))
    return rec.without_preamble(rows).groupBy("doc", "lang").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(_SQL_RUNS + " SELECT q, first FROM a WHERE first BETWEEN 2 AND 5 ORDER BY first, q LIMIT 1")
def worked_example(spark, d):
    base, _ = _runs(spark, d)
    return me.worked_example(base, "q", "first").select("q", "first")


@query("SELECT lang, count(*) AS n, count(CASE WHEN n_chars > 500 THEN 1 END) AS reasoning, count(DISTINCT source) AS topics FROM documents GROUP BY lang")
def question_mix(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_chars") > 500, 1)).alias("reasoning"), F.count_distinct("source").alias("topics"))


@query("SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 3 GROUP BY event_type")
def warm_latency(spark, d):
    return me.warm_latency(_t(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"], "event_type", "value", 3)


@query("SELECT count(*) AS articles, count(CASE WHEN doc_id % 50 <> 0 THEN 1 END) AS live, count(CASE WHEN doc_id % 50 = 0 THEN 1 END) AS repealed, count(CASE WHEN doc_id % 9 = 0 OR coalesce(text, '') = '' THEN 1 END) AS without_en FROM documents")
def corpus_report(spark, d):
    return rec.corpus_counts(_records(spark, d)).select("articles", "live", "repealed", "without_en")


_HEADING = "CASE n_nationkey % 5 WHEN 0 THEN 'Second Part. ' || n_name WHEN 1 THEN 'BOOK XIV ' || n_name WHEN 2 THEN 'Chapter IX' WHEN 3 THEN 'SECTION XL. ' || n_name ELSE 'Books of ' || n_name END"


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'part' WHEN 1 THEN 'book' WHEN 2 THEN 'chapter' WHEN 3 THEN 'section' END AS level, CASE n_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 14 WHEN 2 THEN 9 WHEN 3 THEN 40 END AS number, CASE n_nationkey % 5 WHEN 2 THEN '' WHEN 4 THEN NULL ELSE n_name END AS rest FROM nation")
def heading_keywords(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", tx.heading_keyword(F.expr(_HEADING)).alias("h")).select("n_nationkey", "h.level", "h.number", "h.rest")
