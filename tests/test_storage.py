"""Indexes, batches, sinks, versions, logs and alerts in time against plain Python versions."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusframe.operators import ann, batches, metrics, retrieval
from corpusframe.sources import ledger, tail, versions
from corpusframe.streaming import timed

# --- search ----------------------------------------------------------------------------------------------


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.5, None]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0, 1.0]), (7, [0.6, 0.8])], "id long, vector array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [1.0, 1.0, 1.0])], "q long, vector array<float>")
    got = {(r.q, r.id, r.score, r.rk) for r in retrieval.top_k(asked, index, 5).collect()}
    assert got == {(10, 1, 1.0, 1), (10, 7, 0.6, 2), (12, 6, 1.0, 1)}
    assert not retrieval.top_k(asked.limit(0), index, 5).count() and not retrieval.top_k(asked, index.limit(0), 5).count()


def test_many_queries_meet_the_index_without_a_broadcast(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    index, asked = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(rows[::5], "q long, vector array<double>")
    want = {(r.q, r.id, r.score, r.rk) for r in retrieval.top_k(asked, index, 7, True).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(retrieval, "CUT_ROWS", 500)
    assert {(r.q, r.id, r.score, r.rk) for r in retrieval.top_k(asked, index, 7, True).collect()} == want
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 5):
        s = np.round(m @ m[q], 4)
        s[q] = -9
        assert [(x[1], x[2]) for x in sorted((x for x in want if x[0] == q), key=lambda x: x[3])] == [(i, s[i]) for i in sorted(range(300), key=lambda i: (-s[i], i))[:7]]


def test_inverted_lists(spark, tmp_path):
    """Clustered vectors: few lists give nearly all neighbours, calibration finds how many, partitions are pruned."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(30, 16)) * 3
    rows = [(i, (centres[i % 30] + draw.normal(size=16)).tolist()) for i in range(3000)] + [(9000 + i, centres[0].tolist()) for i in range(500)] + [(9999, None)]
    index = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = index.where("id % 60 = 0").withColumnRenamed("id", "q")
    lists = ann.Lists.build(index, str(tmp_path / "i"), 40)
    assert lists.table().count() == 3500 and len(lists.centroids) == 40
    probes = lists.calibrated(10, 0.97)
    assert probes < 20
    true = {(r.q, r.id) for r in retrieval.top_k(asked, index, 10, True).collect()}
    found = {(r.q, r.id) for r in lists.search(asked, 10, probes, True).collect()}
    assert len(true & found) >= 0.95 * len(true)
    one, _ = lists.probed(asked.where("q = 60"), 2)
    assert re.search(r"PartitionFilters: \[list#\d+ (IN|INSET)", one._jdf.queryExecution().toString()) and len({r["list"] for r in one.select("list").distinct().collect()}) == 2
    assert {tuple(r) for r in lists.search(asked, 10, 40, True).collect()} == {tuple(r) for r in retrieval.top_k(asked, index, 10, True).collect()}
    with pytest.raises(ValueError, match="no vector"):
        ann.Lists.build(index.limit(0), str(tmp_path / "j"))


# --- batches -----------------------------------------------------------------------------------------------------


def greedy(rows, budget):
    """Longest first; a batch takes the next text while its items times its longest stay within the budget."""
    out, batch, held, longest = [], -1, 0, 0
    for i, n in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        n = n or 0
        if batch < 0 or held and max(longest, n) * (held + 1) > budget:
            batch, held, longest = batch + 1, 0, 0
        held, longest = held + 1, max(longest, n)
        out.append((i, n, batch))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_the_greedy_rule(spark, seed, monkeypatch):
    monkeypatch.setattr(batches, "PIECE_BITS", 4)
    pick = random.Random(seed)
    rows = [(i * pick.choice([1, 3]) + seed * 7, pick.choice([0, None, 1, 2, 3, 5, 5, 5, 5, 8, 40, 200])) for i in range(300)]
    rows = list({i: (i, n) for i, n in rows}.values())
    for budget in (1, 10, 64, 1000):
        got = batches.packed(spark.createDataFrame(rows, "id long, n int"), budget)
        assert sorted((r.id, r.n, r.batch) for r in got.collect()) == greedy(rows, budget)
    assert not batches.packed(spark.createDataFrame([], "id long, n int"), 5).count()


def test_encoded_in_input_order(spark):
    texts = [(i, ["a", "bb bb", None, "c c c c c c", ""][i % 5]) for i in range(57)]
    seen = batches.encoded(spark.createDataFrame(texts, "id long, text string").repartition(5), 6, lambda ts: [len(t.split()) for t in ts], lambda ts: np.array([[len(t), 3.0] for t in ts])).collect()
    assert [(r.id, r.text) for r in seen] == texts
    assert all(abs(r.vector[0] - len(r.text or "") / (len(r.text or "") ** 2 + 9) ** 0.5) < 1e-6 for r in seen)


def test_token_windows_equal_a_tokenizers_offsets(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    loaded = {}

    def offsets(texts):
        from tokenizers import Tokenizer

        t = loaded.setdefault(path, None) or loaded.update({path: Tokenizer.from_file(path)}) or loaded[path]
        return [e.offsets for e in t.encode_batch(texts, add_special_tokens=False)]

    texts = [None, "", "one", "Two lines\nof text, é and 😀 too.\n\n  Third   line " * 9, "x" * 300, "日本語 のテキスト " * 20]
    got = {(r.id, r.w): (r.n_tokens, r.chunk) for r in batches.token_windows(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 20, 6, offsets).collect()}
    want = {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        o = own.encode(t, add_special_tokens=False).offsets
        starts = [0] if len(o) <= 20 else [s for s in range(0, len(o), 14) if s == 0 or s + 6 < len(o)]
        for w, s in enumerate(starts):
            part = o[s : s + 20]
            want[i, w] = (len(part), t if len(o) <= 20 else t[part[0][0] : part[-1][1]].strip())
    assert got == want and any("\n" in c for _, c in got.values())


# --- sinks -------------------------------------------------------------------------------------------------------


def test_a_batch_that_is_killed_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    spark.range(10, 14).coalesce(1).write.mode("append").parquet(source)
    mark, stopped = ledger._mark, []

    def killed(*args):
        if not stopped:
            stopped.append(args)
            raise RuntimeError("killed between write and commit")
        return mark(*args)

    monkeypatch.setattr(ledger, "_mark", killed)

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.withColumnRenamed("id", "v").writeStream.foreachBatch(ledger.sink(path)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    assert ledger.batches(spark, path) == [] and ledger.rows(spark, path, "v long").count() == 0
    run()
    assert sorted(r.v for r in ledger.rows(spark, path).collect()) == list(range(14))
    done = ledger.batches(spark, path)
    assert not ledger.write_once(spark.range(99).withColumnRenamed("id", "v"), path, done[-1]) and ledger.rows(spark, path).count() == 14


def test_gauges_are_replaced_by_group(spark, tmp_path):
    path = str(tmp_path / "g")
    push = lambda b, rows: ledger.write_once(spark.createDataFrame(rows, "label string, name string, v double"), path, b)
    push(0, [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), (None, "x", 9.0)])
    push(1, [("a", "x", 5.0)])
    push(2, [(None, "x", 8.0)])
    assert sorted((str(r.label), r.name, r.v) for r in ledger.gauges(ledger.rows(spark, path), "label").collect()) == [("None", "x", 8.0), ("a", "x", 5.0), ("b", "x", 3.0)]
    assert ledger.alert_lines(spark.createDataFrame([("a", 3, "firing")], "label string, tick long, state string")).first().line == '{"label":"a","tick":3,"state":"firing"}'
    assert [r.v for r in ledger.latest_runs(ledger.rows(spark, path), "name").where("name = 'y'").collect()] == [2.0]


# --- versions and logs ---------------------------------------------------------------------------------------------


def test_versions(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"), "k")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, t string")
    seen = lambda df: sorted((r.k, r.t) for r in df.collect())
    assert v.current() == 0 and v.lookup([1]) is None
    v.upsert(spark.range(-500, 500).select(F.col("id").alias("k"), F.lit("old").alias("t")), files=10)
    first = v.read()
    assert len(v.files_for([-500])) == 1 and len(v.files_for([-500, 499])) == 2 and not v.files_for([12345])
    assert len(v.lookup([7]).inputFiles()) == 1
    v.upsert(rows((7, "new"), (7, "newer"), (1000, "more")), files=1)
    v.delete(rows((8, ""), (7777, "")), files=1)
    assert seen(v.lookup([7, 8, 9, 1000])) == [(7, "newer"), (9, "old"), (1000, "more")] and v.read().count() == 1000
    assert seen(v.lookup([7, 8], version=1)) == [(7, "old"), (8, "old")]
    v.upsert(rows((8, "back")), files=1)
    before = seen(v.read())
    assert v.compact(files=5) == 5 and seen(v.read()) == before and v.manifest().count() == 5 and not v.manifest().where("tombstone").count()
    assert first.count() == 1000 and first.where("t = 'old'").count() == 1000  # the reader of version 1 is not disturbed
    v.vacuum(5)
    assert seen(v.read()) == before and seen(v.lookup([8])) == [(8, "back")]
    with pytest.raises(Exception, match="no key"):
        v.upsert(rows((None, "x")))


def test_a_log_is_read_from_its_end(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 50) for i in range(20_000)]
    log = tmp_path / "log"
    log.mkdir()
    for at in range(4):
        (log / f"{at}.txt").write_text("\n".join(lines[at * 5000 : (at + 1) * 5000]) + ("\n" if at < 3 else ""))
    for n in (1, 10, 200, 5000, 5003, 12_000, 30_000):
        assert [r.value for r in tail.last_lines(spark, str(log), n).collect()] == lines[::-1][:n]
    assert [r.value for r in tail.last_lines(spark, str(log / "3.txt"), 3).collect()] == lines[:-4:-1]
    size = []
    for copies in (1, 30):
        (tmp_path / "one").write_text(("\n".join(lines) + "\n") * copies)
        reader = tail.TailReader(str(tmp_path / "one"), 100)
        planned = reader.partitions()
        size.append((reader.bytes_planned, sum(p.end - p.start for p in planned)))
    assert size[0] == size[1] and size[0][0] <= 2 * tail.STEP  # what is read does not grow with the log
    (tmp_path / "empty").write_text("")
    assert not tail.last_lines(spark, str(tmp_path / "empty"), 5).count()


# --- alerts in time --------------------------------------------------------------------------------------------------


def ticks(events, least, every, hold, quiet, until=None):
    """The state on every tick, one after another."""
    out = []
    for label in sorted({e[0] for e in events}):
        own = sorted((t, v) for lab, t, v in events if lab == label)
        tick = -(-own[0][0] // every) * every
        state, since = "ok", None
        while tick <= (until if until is not None else own[-1][0] + quiet + 2 * every):
            t, v = [x for x in own if x[0] <= tick][-1]
            if tick - t >= quiet:
                new, since = "silent", None
            elif v < least:
                since = tick if since is None else since
                new = "firing" if tick - since >= hold else "ok"
            else:
                new, since = "ok", None
            if new != state:
                out.append((label, tick, new))
            state, tick = new, tick + every
    return sorted(out)


def some_events(seed):
    pick, t, out = random.Random(seed), 0, []
    for _ in range(400):
        t += pick.choice([1, 5, 29, 30, 31, 60, 200])
        out.append((pick.choice("abc"), t + 1_700_000_000, pick.choice([0.1, 0.5, 0.79, 0.8, 0.9])))
    return out


@pytest.mark.parametrize(("hold", "quiet"), [(0, 300), (90, 300), (45, 120), (600, 150), (0, 30)])
def test_timeline_equals_a_walk_over_ticks(spark, hold, quiet):
    events = some_events(hold + quiet)
    df = spark.createDataFrame(events, "label string, s long, value double").select("label", F.timestamp_seconds("s").alias("ts"), "value")
    got = timed.timeline(df, "label", "ts", "value", 0.8, 30, hold, quiet)
    assert sorted(tuple(r) for r in got.collect()) == ticks(events, 0.8, 30, hold, quiet)


def test_timers_fire_without_events_of_the_label(spark, tmp_path):
    """A stream gives what the batch query gives up to its watermark; silence and a held alert come by timers."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = [(lab, t, v) for lab, t, v in some_events(11)][:150]
        events += [("d", events[60][1], 0.1)]  # one event below the bound, then silence
        events = sorted(events, key=lambda e: e[1])
        parts = [events[i : i + 40] for i in range(0, len(events), 40)]
        schema = "label string, ts timestamp, value double"
        for i, p in enumerate(parts):
            df = spark.createDataFrame(p, "label string, s long, value double").select("label", F.timestamp_seconds("s").alias("ts"), "value")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = timed.watched(stream, "label", "ts", "value", 0.8, 30, 60, 300, late="0 seconds")
        q = out.writeStream.format("memory").queryName("timed_alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(tuple(r) for r in spark.table("timed_alerts").collect())
        want = ticks(events, 0.8, 30, 60, 300, until=events[-1][1])
        assert [x for x in want if x[0] == "d"] == [("d", x[1], x[2]) for x in want if x[0] == "d"] and {x[2] for x in want if x[0] == "d"} == {"firing", "silent"}
        # ticks behind the last watermark that a batch saw are still to come
        last = max(x[1] for x in got)
        assert got == [x for x in want if x[1] <= last] and len(got) >= 0.8 * len(want)
    finally:
        spark.conf.unset(conf)


# --- quantiles -------------------------------------------------------------------------------------------------------


def test_sketches_stay_within_their_bound(spark):
    """Stored by part, merged, and compared with exact ranks; the sketch does not grow with the group."""
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("part"), F.pow(F.rand(7), 3).alias("v"))
    df = df.cache()
    parts = metrics.quantile_sketches(df, ["g", "part"], "v", 512)
    whole = metrics.merged_sketches(parts, ["g"], 512).select("g", "n", F.length("sketch").alias("size"), *metrics.sketched("sketch", {"p50": 0.5, "p95": 0.95, "p99": 0.99})).collect()
    bound = 2 * 2.3 / 512**0.9
    for r in whole:
        assert r.n == 100_000 and r["size"] < 40_000
        for name, rank in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            at = df.where((F.col("g") == r.g) & (F.col("v") <= r[name])).count() / r.n
            assert abs(at - rank) <= bound
    odd = spark.createDataFrame([(1, None), (1, float("nan")), (1, 4.0), (2, None)], "g int, v double")
    assert [(r.g, r.n, r.p) for r in metrics.quantile_sketches(odd, ["g"], "v").select("g", "n", *metrics.sketched("sketch", {"p": 0.5})).collect()] == [(1, 1, 4.0)]


def test_relevancy_and_recall(spark):
    made = spark.createDataFrame([(1, 0.5, False), (1, 1.0, False), (2, 0.9, True), (3, None, False)], "q int, s double, evasive boolean")
    assert {(r.q, r.n, r.relevancy) for r in metrics.answer_relevancy(made, "q", F.col("s"), "evasive").collect()} == {(1, 2, 0.75), (2, 1, 0.0), (3, 0, None)}
    s = spark.createDataFrame([(1, "x", True), (1, "x", False), (1, "y", False), (1, "z", None), (2, "x", None)], "q int, statement string, a boolean")
    assert {(r.q, r.n, r.recall) for r in metrics.context_recall(s, "q", "a").collect()} == {(1, 2, 0.5), (2, 0, None)}


def test_quantiles_are_exact_beyond_a_sketch(spark):
    """Groups larger than their sketch, with repeats, nulls and NaN, against sorted values; a group of nulls has a row."""
    rows = [(g, float((i * 7919) % 5003) / 4 if i % 11 else 3.5) for g, n in (("a", 6000), ("b", 37), (None, 900)) for i in range(n)]
    rows += [("a", None), ("b", float("nan")), ("c", None)]
    ranks = {"p0": "0.0", "p50": "0.5", "p95": "0.95", "p99": "0.99", "p100": "1"}
    got = {r.g: r for r in metrics.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ranks, 16).collect()}
    con = duckdb.connect()
    for g in ("a", "b", None):
        v = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (x != x, x))
        for name, rank in ranks.items():
            want = con.execute(f"SELECT quantile_disc(x, {rank}) FROM (SELECT unnest(?) AS x)", [v]).fetchall()[0][0]
            assert repr(got[g][name]) == repr(want), (g, name)
        assert got[g].n == len(v)
    assert (got["c"].n, got["c"].p50) == (0, None) and len(got) == 4
    log = spark.createDataFrame([("a", h, float(v)) for h in range(3) for v in range(200)] + [("b", 0, None)], "g string, h int, v double").withColumn("ts", F.expr("timestamp_seconds(h * 3600)"))
    slid = metrics.sliding_quantiles(log, "ts", ["g"], "v", "1 hour", 2, {"p90": "0.9"}, 16).select(F.unix_timestamp("start").alias("s"), "g", "n", "p90").collect()
    assert sorted(map(tuple, slid)) == [(-3600, "a", 200, 179.0), (-3600, "b", 0, None), (0, "a", 400, 179.0), (0, "b", 0, None), (3600, "a", 400, 179.0), (7200, "a", 200, 179.0)]


def test_copies_and_long_batches_stay_small(spark, monkeypatch):
    """Of copies that tie, a block gives k a query, those with the least ids; a tokenizer never gets a whole Arrow batch."""
    handed = []
    monkeypatch.setattr(retrieval, "_cut", lambda parts, k, old=retrieval._cut: (handed.extend(map(len, parts)), old(parts, k))[1])
    rows = [(i, [1.0, float(i % 2)]) for i in reversed(range(600))]
    index = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    pairs = retrieval.blocks(index, "i").crossJoin(retrieval.blocks(index.where("id < 4"), "q"))
    got = retrieval.nearest(pairs, 3, skip_self=True).select("q", "id").collect()
    assert sorted(map(tuple, got)) == [(q, i) for q in range(4) for i in [x for x in range(q % 2, 10, 2) if x != q][:3]]
    captured = {}
    fake = type("Pairs", (), {"schema": pairs.schema, "mapInArrow": lambda self, f, out: captured.update(f=f) or pairs.limit(0).selectExpr("0L AS q", "0L AS id", "0D AS score")})()
    retrieval.nearest(fake, 3, skip_self=True)
    assert sum(b.num_rows for b in captured["f"](iter(pairs.toArrow().to_batches()))) == 12 and max(handed) == 12
    monkeypatch.setattr(batches, "CHARS_AT_ONCE", 10)
    monkeypatch.setattr(batches.F, "pandas_udf", lambda kind: lambda f: f)
    sizes = []
    spans = batches.spans(lambda texts: sizes.append(len(texts)) or [[(0, len(t))] if t else [] for t in texts])
    (out,) = spans(iter([pd.Series(["abcde", "fghij", None, "k" * 30, "", "l"])]))
    assert sizes == [3, 1, 2] and [list(x) for x in out["ends"]] == [[5], [5], [], [30], [], [1]]


def test_large_tables_are_written_in_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_BYTES", 1000)
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("x" * 42).alias("v"))
    t = versions.Versions(spark, str(tmp_path / "t"), "k")
    assert t.manifest(t.upsert(rows, files=2)).count() > 10
    t.delete(rows.where("k >= 390"), files=1)
    assert t.manifest(t.compact(files=2)).count() > 10 and t.read().count() == 390


def test_band_join_meets_steps_of_the_band(spark):
    """Rows of a nation are dealt by steps of the balance too, so that no task has all pairs of a nation."""
    import __spark_entry__ as entry

    plan = entry.queries()["band_join_y"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join Inner" in x)
    assert "step" in join and "s_nationkey" in join
