"""Each operator against a plain Python version, and its SQL where there is some."""

import collections
import datetime
import hashlib
import itertools
import json
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusframe.llm import bpe, chunks, common, fingerprint, language, licences, minhash, mixing, privacy, quality, suffixes
from corpusframe.llm.queries import ORACLES, QUERIES, tokenizer_path

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Rows of (doc_id, text, source), or texts."""
    rows = [(i, r, "a") if isinstance(r, str | None) else r for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def words(pick, n):
    return " ".join(f"{pick.choice('abcdefghij')}{pick.randint(0, 10**6)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    want = con.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda names, data: sorted(str([None if r[names.index(c)] is None else r[names.index(c)] for c in order]) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


# --- mixing -----------------------------------------------------------------------------------------------


def test_mix_shards_slots_and_blocks(spark):
    pick = random.Random(3)
    docs = table(spark, [(i, " ".join(["w"] * pick.randint(0, 60)), pick.choice(["a", "b", None])) for i in range(200)])
    mix = mixing.Mix(docs, block_words=8, shard_blocks=16)
    slots = [r.asDict() for r in mix.slots.collect()]
    q = {r.s: r for r in mixing.quotas(mix.documents.select("source", "s", "total", "weight", "target").distinct(), 8).collect()}
    assert collections.Counter(r["s"] for r in slots) == {s: r.slots for s, r in q.items()}
    # every shard but the last is full, and a source's slots run on from shard to shard
    per = collections.Counter(r["shard"] for r in slots)
    assert [per[k] for k in sorted(per)][:-1] == [16] * (len(per) - 1) and sorted(per) == list(range(len(per)))
    counts = {(r.shard, r.s): r.n for r in mixing.shard_counts(mixing.quotas(mix.documents.select("source", "s", "total", "weight", "target").distinct(), 8), 16).collect()}
    for s in q:
        at = 0
        for shard in sorted(per):
            own = sorted(r["slot"] for r in slots if r["s"] == s and r["shard"] == shard)
            assert own == list(range(at, at + counts.get((shard, s), 0)))
            at += len(own)
        # each epoch is a permutation of the blocks, the last one a part of one
        for epoch, rows in itertools.groupby(sorted((r["epoch"], r["block"]) for r in slots if r["s"] == s), key=lambda x: x[0]):
            blocks = [b for _, b in rows]
            assert len(set(blocks)) == len(blocks) and (set(blocks) == set(range(q[s].blocks)) or epoch == (q[s].slots - 1) // q[s].blocks)
    # the words taken, anew from blocks and slots
    times = collections.Counter((r["s"], r["block"]) for r in slots)
    pieces = [r.asDict() for r in mix.pieces.collect()]
    taken = collections.Counter()
    for p in pieces:
        taken[p["row"]] += (p["hi"] - p["lo"]) * times[p["s"], p["block"]]
    keys = {r.row: r.key for r in mix.documents.collect()}
    got = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, block_words=8, shard_blocks=16).collect()}
    assert got == {keys[row]: taken[row] for row in keys}
    assert "shard" in mix.taken()._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_documents_are_the_words_taken(spark):
    pick = random.Random(5)
    rows = [(i, f" lead  {words(pick, pick.randint(0, 90))}\n tail ", pick.choice(["a", "b", "c"])) for i in range(60)]
    rows += [(7, rows[7][1], rows[7][2])] * 2 + [(None, "x y z", "a"), (None, "x y z", "a"), (99, None, None), (98, "", "b"), (97, "  ", "a")]
    docs = table(spark, rows).withColumn("key", F.lit("k")).withColumn("row", F.lit(1)).withColumn("parts", F.lit(2))
    sizes = mixing.mixed_sizes(docs, block_words=8).collect()
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    took = collections.Counter()
    for r in mixed.collect():
        own = next(t for i, t, _ in rows if i == r.doc_id).split()
        new = r.text.split()
        at = iter(own)
        assert new and all(w in at for w in new) and r.key == "k"  # words in their order
        took[r.doc_id] += len(new)
    want = collections.Counter()
    for r in sizes:
        want[r.doc_id] += r.taken
    assert took == +want


# --- passages ---------------------------------------------------------------------------------------------


def test_every_passage_survives_once(spark):
    pick = random.Random(21)
    p, q, r = (words(pick, 80) for _ in range(3))
    texts = {1: f"{p} {q}", 5: f"{p} {q} {r}", 9: f"{q} {r}"}
    df = table(spark, [(i, t, "a") for i, t in texts.items()])
    left = {x.doc_id: x.text for x in chunks.without_repeats(df).collect()}
    for passage in (p, q, r):
        core = " ".join(passage.split()[8:-8])
        assert sum(core in t for t in left.values()) == 1 and core in left[min(i for i, t in texts.items() if core in t)]


def test_chunk_passages_hold_in_plain_python(spark):
    pick = random.Random(22)
    shared = [words(pick, 60) for _ in range(6)]
    texts = [" ".join(x for _ in range(pick.randint(1, 3)) for x in (words(pick, pick.randint(5, 40)), pick.choice(shared))) for _ in range(40)]
    got = chunks.repeated_passages(table(spark, texts)).collect()
    covered = collections.defaultdict(set)
    for r in got:
        piece = texts[r.doc_id].encode()[r.start : r.start + r.size]
        assert piece in texts[r.first_id].encode() and r.first_id <= r.doc_id and r.keep == (r.first_id == r.doc_id)
        assert sum(piece in t.encode() for t in texts) > 1
        covered[r.doc_id] |= set(range(r.start, r.start + r.size))
    for i, t in enumerate(texts):
        for s in shared:
            at = t.find(s)
            if at >= 0 and sum(s in x for x in texts) > 1:
                assert len(covered[i] & set(range(at, at + len(s)))) >= 0.7 * len(s)


def test_suffix_passages_equal_brute_force(spark):
    pick = random.Random(23)
    shared = [[f"s{k}x{i}" for i in range(pick.randint(45, 120))] for k in range(8)]
    footer = [f"f{i}" for i in range(35)]
    texts = [" ".join([*words(pick, 30).split(), *pick.choice(shared), *(footer if i % 2 else []), *words(pick, 10).split()]) for i in range(60)] + [None, "", "a b"]
    split = [(t or "").split() for t in texts]
    holders = collections.defaultdict(set)
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    want = set()
    for i, w in enumerate(split):
        own = [k for k in range(len(w) - 49) if len(holders[tuple(w[k : k + 50])]) > 1]
        want |= {(i, x) for k in own for x in range(k, k + 50)}
    found = suffixes.repeated_passages(table(spark, texts)).collect()
    got = {(r.doc_id, x) for r in found for x in range(r.first_word, r.first_word + r.n_words)}
    assert got == want
    for r in found:  # the smallest other holder of 50 words of the passage
        w = split[r.doc_id]
        assert r.other_id == min(i for k in range(r.first_word, r.first_word + r.n_words - 49) for i in holders[tuple(w[k : k + 50])] if i != r.doc_id)


@pytest.mark.parametrize(("copies", "parts"), [(2, 4), (3, 4), (40, 4), (40, 40)])
def test_other_id_means_the_same_for_few_and_many_copies(spark, copies, parts):
    """Passages in few and in many documents, in one task and cut over many."""
    pick = random.Random(copies)
    shared = words(pick, 60)
    texts = [f"{words(pick, 20)} {shared} {words(pick, 15)}" for _ in range(copies)] + [words(pick, 90) for _ in range(5)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.doc_id, r.first_word, r.n_words, r.other_id) for r in suffixes.repeated_passages(table(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {(i, 20, 60, 0 if i else 1) for i in range(copies)}


def test_marks_of_a_text_are_looked_for_once(spark, tmp_path, monkeypatch):
    """Words are hashed for marks once, not once to find common grams and again to find their places."""
    plain, seen = suffixes._marks, str(tmp_path / "seen")

    def counted(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.writelines(f"{x}\n" for x in b.column(0).to_pylist())
            yield from plain(iter([b]))

    monkeypatch.setattr(suffixes, "_marks", counted)
    shared = " ".join(f"s{i}" for i in range(60))
    assert suffixes.repeated_passages(table(spark, [f"a {shared}", f"b c {shared}", "d"])).count() == 2
    with open(seen) as f:
        assert sorted(f.read().split()) == ["0", "1", "2"]


@pytest.mark.parametrize("together", [1, 1000])
def test_minimisers_and_fingerprints_of_texts_one_behind_another(monkeypatch, together):
    """Equal to each text by itself, place by place."""
    monkeypatch.setattr(suffixes, "PIECE_WORDS", together)
    pick = random.Random(29)
    texts = [" ".join(pick.choice("abcd") for _ in range(n)) for n in [0, 1, 7, 8, 38, 39, 40, 49, 50, 51, 90, 300, 5, 200]]
    ids = pa.array(range(len(texts)))
    marked = [r for b in suffixes._marks([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["id", "text"])]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want, mask = [], (1 << 64) - 1
    for i, t in enumerate(texts):
        h = [int(x) for x in suffixes._word_hashes(t.encode())]
        g = []
        for k in range(len(h) - suffixes.GRAM + 1):
            x = sum(a * int(b) for a, b in zip(h[k:], suffixes._FACTORS, strict=False)) & mask
            x = (x ^ x >> 31) * 0x9FB21C651E98DF25 & mask
            g.append(x ^ x >> 28)
        starts = range(max(1, len(g) - suffixes.WINDOW + 1)) if g else []
        at = sorted({min(range(k, min(len(g), k + suffixes.WINDOW)), key=lambda j: (g[j], -j)) for k in starts})
        want += [(i, g[k] - (g[k] >> 63 << 64), k) for k in at]
    assert marked == want
    places = pa.array([[p for i, _, p in want if i == k][::2] for k in range(len(texts))], pa.list_(pa.int64()))
    got = [r for b in suffixes._suffixes([pa.RecordBatch.from_arrays([ids, pa.array(texts), places], names=["id", "text", "places"])]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    told = []
    for i, t in enumerate(texts):
        h = [int(x) for x in suffixes._word_hashes(t.encode())]
        for k in range(len(h) - suffixes.PASSAGE + 1):
            if any(p + suffixes.GRAM - suffixes.PASSAGE <= k <= p for p in places[i].as_py()):
                x = 0
                for y in h[k : k + suffixes.PASSAGE]:
                    x = (x * int(suffixes._ROLL) + y) & mask
                x = (x ^ x >> 31) * 0x9FB21C651E98DF25 & mask
                x ^= x >> 29
                told.append((i, x - (x >> 63 << 64), k))
    assert got == told


# --- tokens -----------------------------------------------------------------------------------------------


def merged(merges, data):
    """Byte-pair encoding as it is defined: the lowest merge first, its leftmost place first."""
    parts = [bytes([b]) for b in data]
    while len(parts) > 1:
        rank, at = min((merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_automaton_equals_explicit_gadgets():
    pick = random.Random(31)
    shown = {b: c for c, b in bpe.byte_alphabet().items()}
    for _ in range(25):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(12):
            a, b = pick.choice(tokens), pick.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        spelled = lambda x: "".join(shown[i] for i in x)
        auto = bpe.Automaton({"model": {"vocab": {spelled(t): i for i, t in enumerate(tokens)}, "merges": [f"{spelled(a)} {spelled(b)}" for a, b in merges]}})
        # states and arcs built one by one
        arcs, target = [dict.fromkeys(range(3), 0)], {t: 0 for t in range(3)}
        for number, (a, b) in enumerate(merges):
            a, b, c = (tokens.index(x) for x in (a, b, a + b))
            if a not in target or b not in target or b not in arcs[target[a]]:
                continue
            new = len(arcs)
            to = target[b]
            arcs.append({k: v for k, v in arcs[target[a]].items() if k != b})
            for state in arcs:
                if a in state:
                    state[a] = new
            target[a], target[c] = new, to
            for state in arcs:
                if a in state:
                    state[c] = to
        rank = {m: i for i, m in enumerate(merges)}
        for n in range(1, 7):
            for letters in itertools.product(b"abc", repeat=n):
                word = bytes(letters)
                ids = [auto.accepted[x] for x in merged(rank, word)] if all(x in auto.accepted for x in merged(rank, word)) else None
                if ids is not None:
                    import array

                    assert array.array("i", auto.encode_word(word)).tolist() == ids
        for a in target:
            for b in target:
                assert auto.leads(a, b) == (b in arcs[target[a]])


def test_word_memory_is_bounded():
    auto = bpe.Automaton(json.loads(bpe.load_spec(tokenizer_path())))
    pick = random.Random(32)
    text = " ".join(f"q{pick.randint(0, 10**9)}z" for _ in range(250_000)) + " " + "x" * 5000
    auto.encode(text)
    assert auto.held <= bpe.KEPT_BYTES + 1000 and len(auto.arcs) <= bpe.KEPT_ARCS
    assert all(len(w) + len(i) <= bpe.LONGEST_KEPT for m in (auto.memory, auto.older) for w, i in m.items())


# --- privacy ----------------------------------------------------------------------------------------------


def test_pseudonyms_are_one_to_one_and_linked(spark):
    start = datetime.date(1990, 1, 1)
    dates = [str(start + datetime.timedelta(days=i)) for i in range(2000)]
    phones = [f"+49 30 {i:07d}" for i in range(500, 1500)]
    got = [r.text for r in privacy.pseudonymized(table(spark, dates + phones), "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(got) and all(g != t for g, t in zip(got, dates + phones))
    assert all(datetime.date.fromisoformat(g) for g in got[:2000]) and all(re.fullmatch(r"\+49 \d{2} \d{7}", g) for g in got[2000:])
    texts = ["12/25/2020", "2020-12-25", "25.12.2020", "12.25.2020", "+1 (830) 555-5433", "830-555-5433"]
    a, b, c, e, f, g = (r.text for r in privacy.pseudonymized(table(spark, texts), "k").orderBy("doc_id").collect())
    y, m, d = b.split("-")
    assert (a, c, e) == (f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{m}.{d}.{y}") and f == f"+1 ({g[:3]}) {g[4:]}"
    other = [r.text for r in privacy.pseudonymized(table(spark, texts), "another").orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip((a, b, c, e, f, g), other))
    with pytest.raises(ValueError):
        privacy.pseudonymized(table(spark, texts), "")


def feistel(key, kind, n, left, right, ml, mr):
    """The network as it is defined: eight rounds, each adding a keyed digest of one half to the other."""
    halves, sizes = [left, right], [ml, mr]
    for i in range(8):
        told = hashlib.sha256("|".join(map(str, [key, kind, *([] if n is None else [n]), i, halves[1 - i % 2]])).encode()).hexdigest()[:15]
        halves[i % 2] = (halves[i % 2] + int(told, 16)) % sizes[i % 2]
    return halves


def moved_digits(key, kind, d):
    n = len(d)
    a, b = feistel(key, kind, n, int(d[: n // 2] or 0), int(d[n // 2 :]), 10 ** (n // 2), 10 ** (n - n // 2))
    return (f"{a:0{n // 2}d}" if n // 2 else "") + f"{b:0{n - n // 2}d}"


def filled(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def moved_date(key, day):
    n = (day - datetime.date(1800, 1, 1)).days
    a, b = feistel(key, "date", None, n // 773, n % 773, 189, 773)
    return datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(map(int, reversed(d)))) % 10


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_pseudonyms_equal_plain_python(spark):
    """Every kind of value by the network as it is written down, in every notation."""
    key = "a key"
    day = lambda y, m, d: moved_date(key, datetime.date(y, m, d))
    want = {}
    for c in ("4068516892505468", "4068-5168-9250-5468", "378282246310005"):
        new = moved_digits(key, "card", re.sub("[^0-9]", "", c)[:-1])
        want[c] = filled(c, new + str((10 - luhn(new + "0")) % 10))
    for p, front in (("+49 30 1234567", "49"), ("0049 30 1234567", "0049"), ("030 1234567", "0"), ("(030) 1234567", "0"), ("089/123 45678", "0"), ("+1 (830) 555-5433", "1"), ("830-555-5433", ""), ("(830) 555-5433", "")):
        digits = re.sub("[^0-9]", "", p)
        want[p] = filled(p, front + moved_digits(key, "phone", digits[len(front) :]))
    want["078-05-1120"] = filled("078-05-1120", moved_digits(key, "ssn", "078051120"))
    a, b = feistel(key, "address", None, 10 * 256 + 1, 2 * 256 + 255, 65536, 65536)
    want["10.1.2.255"] = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for x in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606"):
        plain = x.replace(" ", "")
        body = filled(plain[4:], moved_digits(key, "iban", re.sub("[^0-9]", "", plain[4:])))
        new = plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body
        assert mod97(plain) == 1 and mod97(new) == 1
        it = iter(new)
        want[x] = "".join(" " if c == " " else next(it) for c in x)
    x, y = day(1999, 4, 3), day(1980, 3, 1)
    want |= {"1999-04-03": str(x), "03/04/1999": f"{x:%d/%m/%Y}", "3/4/1999": f"{x.day}/{x.month}/{x.year}", "03.04.1999": f"{x:%d.%m.%Y}", "3.4.1999": f"{x.day}.{x.month}.{x.year}"}
    want |= {"1 March 1980": f"{y.day} {y:%B} {y.year}", "March 1, 1980": f"{y:%B} {y.day}, {y.year}", "1 Mar 1980": f"{y.day} {y:%b} {y.year}", "Mar 1, 1980": f"{y:%b} {y.day}, {y.year}"}
    z = day(2020, 12, 25)
    want |= {"12/25/2020": f"{z:%m/%d/%Y}", "25 December 2020": f"{z.day} {z:%B} {z.year}"}
    six = hashlib.sha256(f"{key}|address6|2001:0db8:0000:0000:0000:0000:0000:0001".encode()).hexdigest()[:32]
    want |= {x: ":".join(six[i : i + 4] for i in range(0, 32, 4)) for x in ("2001:db8::1", "2001:0DB8:0:0::1", "2001:db8:0:0:0:0:0:1")}
    same = ["DE88 3704 0044 0532 0130 00", "31/02/2001", "30 February 2001", "12:30:45", "std::move a::b beef::cafe", "version 1.2.3", "no 0123 4", "4068516892505467", "1234 5678", "0.123456789", "2001:db8:1", "€ 0,12 345678", "§ 0815"]
    texts = [f"see {v}, and {v}." for v in want] + same
    got = [r.text for r in privacy.pseudonymized(table(spark, texts), key).orderBy("doc_id").collect()]
    assert got == [f"see {n}, and {n}." for n in want.values()] + same


# --- fingerprints, licences, quality, language --------------------------------------------------------------


def test_winnowing_equals_brute_force(spark):
    pick = random.Random(41)
    texts = [" ".join(pick.choice("abcd") for _ in range(pick.randint(0, 40))) for _ in range(80)]
    df = fingerprint.winnowed(table(spark, texts), "text", "f")
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in "abcd"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {}
    needed = {tuple(t.split()[i : i + 3]) for t in texts for i in range(len(t.split()) - 2)}
    rows = spark.createDataFrame([(list(g), [hashed[w] for w in g]) for g in needed], "g array<string>, h array<long>")
    rolled = rows.select("g", F.xxhash64(F.xxhash64(F.col("h")[0], F.col("h")[1]), F.col("h")[2]).alias("r"))
    pairs = {tuple(r.g): r.r & 0xFFFFFFFF for r in rolled.collect()}
    for r in df.collect():
        w = r.text.split()
        got = [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in r.f]
        if len(w) < 3:
            assert len(got) == (1 if w else 0)
            continue
        h = [pairs[tuple(w[i : i + 3])] for i in range(len(w) - 2)]
        h = [x - (1 << 32) if x >= 1 << 32 else x for x in h]
        want = []
        for i in range(max(1, len(h) - 3)):
            view = range(i, min(len(h), i + 4))
            low = max(k for k in view if h[k] == min(h[j] for j in view))
            if (h[low], low) not in want:
                want.append((h[low], low))
        assert [(a & 0xFFFFFFFF, b) for a, b in got] == want


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def test_a_licence_needs_its_mandatory_words():
    scan = lambda t: set(licences.Scanner().scan(t)["labels"].split(","))
    for lead in ("", "MIT License\n\nCopyright (c) 2020 Some Body\n\n", "Copyright 1999, 2001 A B and others. All rights reserved. "):
        assert "mit-text" in scan(lead + MIT)
    assert "mit-text" in scan(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ANY OTHER PARTY")) and "mit-text" in scan(MIT.replace("notice shall", "notice (including the next paragraph) shall"))
    mandatory = MIT.split()
    for k in range(0, len(mandatory), 9):
        changed = " ".join([*mandatory[:k], "otherword", *mandatory[k + 1 :]])
        replaceable = any(x in mandatory[k] for x in ("AUTHORS", "HOLDERS", "COPYRIGHT", "THE", "OR"))
        assert replaceable or "mit-text" not in scan(changed), mandatory[k]


def test_every_template_matches_itself_with_regions_in_and_out():
    scanner = licences.Scanner()

    def text(tree, full):
        for kind, x in tree:
            yield from [x.decode()] if kind == "word" else ["foo"] * (x if full else 0) if kind == "any" else text(x, full) if full else []

    for label, template in licences.TEMPLATES.items():
        for full in (False, True):
            own = list(text(licences.parsed(template), full))
            assert label in scanner.scan(" ".join(["before", *own, "after"]))["labels"].split(","), (label, full)
        first = next(x.decode() for kind, x in licences.parsed(template) if kind == "word")
        own = [w for w in text(licences.parsed(template), False)]
        assert label not in scanner.scan(" ".join(w for w in own if w != first))["labels"].split(",")
    for bad in ("<<optional>> a", "a <<end>>", "<<any:3>> a", "<<optional>> a <<end>>"):
        with pytest.raises((ValueError, IndexError)):
            licences.Scanner({"x": bad})


def test_samples_are_bounded(spark):
    rows = [(None, "the same text", "a")] * 3000 + [(i, f"text {i}", "a") for i in range(500)] + [(1, None, "a")]
    got = common.sampled(table(spark, rows), "doc_id", "text", "lang", 96).collect()
    assert len(got) == 96 and len({r.hash for r in got}) == 96
    dictionary = language.fit(table(spark, [(i, f"w{i} " * (3 if i % 2 else 4000), "a") for i in range(200)]), size=9600)
    assert len(dictionary["en"]) <= 9600 and len({w for w in dictionary["en"].decode().split() if re.fullmatch(r"w\d+", w)}) >= 96


def test_language_margins(spark):
    pick = random.Random(51)
    vocabulary = {"en": [words(pick, 1) for _ in range(200)], "de": [words(pick, 1) for _ in range(200)]}
    rows = [(i, " ".join(pick.choices(vocabulary[x], k=80)), x) for i, x in enumerate(["en", "de"] * 60)]
    docs = spark.createDataFrame([(i, t, x, None, 0) for i, t, x in rows], SCHEMA)
    d = language.fit(docs)
    both = " ".join(w for pair in zip(vocabulary["en"][:40], vocabulary["de"][:40]) for w in pair)
    odd = spark.createDataFrame([(1, None, "en", "x", 0), (2, "123 !", "en", "x", 0), (3, "", None, "x", 0), (None, rows[0][1], "de", "x", 0)], SCHEMA)
    assert {r.lang_pred for r in language.identified(odd.where("doc_id IS NOT NULL"), d).collect()} == {"und"}
    got = language.identified(docs.withColumn("score", F.lit("old")), d)
    assert got.where("lang <> lang_pred").count() == 0 and got.columns.count("score") == 1
    assert [r.doc_id for r in language.accepted(odd, d).collect()] == [None] and language.accepted(odd, d).columns == odd.columns
    s = language.Classifier(d).predict(both)[1]
    assert s < 0.1 < language.Classifier(d).predict(rows[0][1])[1] and language.accepted(table(spark, [both]), d, margin=s + 0.01).count() == 0


def test_one_language_and_sizes_of_zstandard(spark):
    """Scores stay in [0, 1] with one language; with more, size by size what zstandard makes of a text."""
    import zstandard

    one = language.Classifier({"en": b"the quick brown fox " * 30})
    assert one.predict("x") == ("en", 0.0) and one.predict("qzxw jk vb") == ("en", 0.0) and one.predict("7 !") == ("und", 0.0)
    assert 0 < one.predict("the quick brown fox the quick brown fox")[1] <= 1
    pick = random.Random(52)
    known = {x: " ".join(words(pick, 1) for _ in range(300)).encode() for x in ("a", "b", "c")}
    texts = [" ".join(pick.choices(known[x].decode().split(), k=n)) for x in known for n in (1, 3, 30, 400)] + ["Zzz", None, "42"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(table(spark, texts), known).collect()}
    for i, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0.0)
            continue
        sizes = {}
        for x, d in known.items():
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=language.LEVEL)
            sizes[x] = len(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.lower().encode()))
        best = min(sorted(sizes), key=sizes.get)
        second = min(s for x, s in sizes.items() if x != best)
        assert got[i] == (best, (second - sizes[best]) / second) and 0 <= got[i][1] <= 1


def test_prints_of_texts_without_blanks(spark):
    """Scripts without blanks have characters as words, long runs are cut; ids may lie far apart."""
    zh = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋"
    run = "".join(random.Random(9).choices("abcdefgh", k=4000))
    df = table(spark, [(1 << 40, zh + "收冬", "a"), (77, zh + "余成", "a"), (5, run, "a"), (-(1 << 50), run[:3000] + "x" * 1000, "a")])
    got = {r.doc_id: r for r in fingerprint.compared(df).collect()}
    assert 0.5 < got[1 << 40].near_next < 1 and got[77].near_edited > 0.3 and 0.4 < got[5].near_next < 1 and got[77].near_next == 0


def test_spans_of_ids_far_apart(spark, monkeypatch):
    """Ranges of spans hold several of them, and the next document is right across them."""
    monkeypatch.setattr(fingerprint, "RANGE", 40)
    pick = random.Random(12)
    ids = sorted(pick.sample(range(-(10**12), 10**12), 300), reverse=True)
    texts = {i: " ".join(pick.choices("abcdefgh", k=12)) for i in ids}
    got = {r.doc_id: r.edited for r in fingerprint.compared(table(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        third = len(texts[i]) // 3
        assert got[i] == texts[i][: len(texts[i]) - third] + texts[nxt][:third]
    spans = fingerprint._spans(spark.createDataFrame([(i,) for i in ids], "id long"), 8)
    assert spans.count() == 300


def test_quality_references_of_every_document(spark):
    pick = random.Random(47)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join(pick.choices(vocabulary[: pick.randint(2, 24)], k=pick.randint(20, 80))) for _ in range(430)]
    df = table(spark, texts).union(table(spark, texts[:5]))  # more than a sample's 400, and five rows twice
    r = quality.References(df)
    counts = collections.Counter(w for t in texts for w in t.split())
    top = sorted(sorted(counts, key=lambda w: (-counts[w], w))[: quality.COMMON_WORDS])
    shares = [counts[w] / counts.total() for w in top]
    reference = [*shares, 1 - sum(shares)]
    assert r.words == top and r.spoken["en"] == pytest.approx(reference)
    spaces, length = sum(t.count(" ") for t in texts), sum(map(len, texts))
    assert r.classes["en"] == pytest.approx([0, 0, spaces / length, 0, 0, 0, 1 - spaces / length])

    def spread(t):
        v = t.split()
        p = [v.count(w) / len(v) for w in top]
        p.append(1 - sum(p))
        part = lambda a, b: a * np.log2(2 * a / (a + b)) if a > 0 else 0.0
        return (max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, reference, strict=True)) / 2) * len(v)) ** 0.5

    low, high = np.quantile([spread(t) for t in texts if len(t.split()) >= quality.LEAST_WORDS], [0.25, 0.75])
    assert r.fence == pytest.approx(high + quality.FENCE * (high - low))


def test_quality_of_every_document_matches_sql(spark):
    d = D.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    limit = f" QUALIFY row_number() OVER (PARTITION BY l ORDER BY h) <= {quality.SAMPLE}"
    assert ORACLES["op10_quality"].count(limit) == 1
    want = con.sql(ORACLES["op10_quality"].replace(limit, ""))
    docs = common.documents(spark, d)
    got = quality.judged(docs, quality.References(docs)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_quality_fitted_on_every_document(spark):
    """Texts counted once give what references fitted apart give, with more labelled documents than a sample has, repeated rows, nulls and
    texts without words (F3); its SQL is that of op10 without the sample."""
    assert "QUALIFY" in ORACLES["op10_quality"] and "QUALIFY" not in ORACLES["quality_fitted"]
    pick = random.Random(53)
    vocabulary = {x: [f"{x}{a}{b}" for a in "abcd" for b in "xyz"] for x in ("en", "de")}
    rows = [(i, " ".join(pick.choices(vocabulary[x][: pick.randint(2, 12)], k=pick.randint(5, 90))) + pick.choice(["", " | #", "\n1 2\n1 2"]), x) for i in range(450) for x in vocabulary]
    rows += rows[:7] + [(1, None, "en"), (None, "1 | 2", "fr"), (None, "1 | 2", "fr"), (2, "", "es"), (3, "enax " * 60, None), (None, None, None)]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], SCHEMA)
    for docs in (df, df.withColumn("lang", F.lit(None).cast("string")), df.where("false")):
        want = quality.judged(docs, quality.References(docs))
        got = quality.judged_by_all(docs)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sample = quality.judged(df, quality.References(df, sample=quality.SAMPLE))
    assert sorted(map(str, sample.collect())) != sorted(map(str, quality.judged_by_all(df).collect()))


@pytest.mark.parametrize("broadcast", [0, 10])
def test_labelled_documents_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_HASHES", broadcast)
    rows = [(1, "a", "en"), (1, "a", "en"), (1, "a", "de"), (2, "a", "en"), (None, "b", "en"), (None, "b", "en"), (3, None, "en"), (4, "c", None)]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], SCHEMA)
    got = common.labelled(df, "doc_id", "text", "lang")
    assert sorted((r.lang, r.text) for r in got.collect()) == [("de", "a"), ("en", "a"), ("en", "a"), ("en", "b")]


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_quantiles_equal_percentiles(spark, n):
    pick = random.Random(n)
    df = spark.createDataFrame([(pick.choice([0.5, pick.random(), pick.random()]),) for _ in range(n)], "x double")
    want = df.agg(F.percentile("x", [0.0, 0.25, 0.75, 1.0])).collect()[0][0]
    assert quality.quantiles(df, "x", [0.0, 0.25, 0.75, 1.0]) == want
    assert quality.quantiles(df.where("x < 0"), "x", [0.5]) == []


# --- odd rows ---------------------------------------------------------------------------------------------


def test_odd_rows_have_defined_values(spark):
    long = words(random.Random(61), 30_000)
    rows = [(1, "a b c d e f", "s"), (1, "g h i j k l", "s"), (None, "call 830-555-5433 now", "s"), (None, None, None), (4, long, "s"), (5, long, None), (6, "", "s")]
    df = table(spark, rows)
    for name in ("key", "row", "_text", "_any", "_new", "_found", "_drop", "ids", "_lang", "doc", "hash", "text_"):
        df = df.withColumn(name, F.lit(name))
    private = privacy.pseudonymized(df, "k", count="n").collect()
    assert sorted(r.n for r in private) == [0, 0, 0, 0, 0, 0, 1] and all(r._any == "_any" and r.doc == "doc" for r in private)
    clean = {(r.doc_id, r.text) for r in chunks.without_repeats(df).collect()}
    assert {t for i, t in clean if i == 5} != {long} and (4, long) in clean and (None, None) in clean and (1, "a b c d e f") in clean
    near = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(near, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 1, None, True), (None, 0, None, True), (4, 29996, 4, True), (5, 29996, 4, False), (6, 0, 6, True)], key=str)
    tokens = bpe.encode_decode(df, tokenizer_path(), keep=["source", "ids", "_text"]).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in tokens) == sorted(str((i, t or "")) for i, t, _ in rows)
    judged = {(r.doc_id, r.n_words): r for r in quality.judged(df, quality.References(df)).collect()}
    assert judged[4, 30_000].kept == judged[5, 30_000].kept and judged[None, 0].base_failed and not judged[6, 0].kept
    scans = {(r.doc_id, r.n_words) for r in licences.scanned(df).collect()}
    assert scans == {(1, 6), (None, 5), (None, 0), (4, 30_000), (5, 30_000), (6, 0)}
    prints = fingerprint.compared(df).collect()
    assert len(prints) == 7 and {r.edited for r in prints if r.doc_id is None} == {"", "call 830-555-543"[: 21 - 7]}
    passages = {r.doc_id: (r.first_word, r.n_words) for r in suffixes.repeated_passages(df).collect()}
    assert passages == {4: (0, 30_000), 5: (0, 30_000)}
    assert sum(r.size for r in mixing.mixed_sizes(df).collect()) == 12 + 3 + 60_000


# --- the pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    pick = random.Random(71)
    vocabulary = {x: [f"{a}{x}{b}" for a in "bcdfgh" for b in "aeiou"] for x in ("en", "de")}
    prose = lambda x, n: " ".join(pick.choices(vocabulary[x], k=n))
    rows = [(i, prose(x, 60), x, f"s{i % 3}", 0) for i, x in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1].replace(" ", "  ", 1), "de", "s1", 0), (102, None, "en", None, 0), (103, "77 !", "de", "s1", 0), (104, prose("en", 40) + " mail a.b@mail3.example.com", "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    kept = docs
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, path).collect(), SCHEMA)
        after = kept.collect()
        names.append(name)
        assert kept.columns == corpus_pipeline.DOCUMENT_COLUMNS
        if name == "language":
            assert {r.doc_id for r in after} == set(before) - {102, 103}
        if name == "near_duplicates":
            assert {r.doc_id for r in after} == set(before) - {100, 101}
        if name == "privacy":
            assert all(r.text == before[r.doc_id].text for r in after if r.doc_id != 104) and all(r.n_chars == len(r.text) for r in after)
            assert "mail3" not in next(r.text for r in after if r.doc_id == 104)
        if name == "mix":
            took = {r.doc_id: r.taken for r in mixing.mixed_sizes(spark.createDataFrame(list(before.values()), SCHEMA)).collect()}
            got = collections.Counter()
            for r in after:
                got[r.doc_id] += len(r.text.split())
            assert got == +collections.Counter(took)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    encoded = corpus_pipeline.encode(spark, kept, path).collect()
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in kept.collect())
    assert sorted((r.doc_id, r.ids) for r in encoded) == want and names == ["language", "near_duplicates", "privacy", "mix"]
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == want
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_white_space_words_stay_apart_in_the_memory():
    from tokenizers import Tokenizer

    a, t = bpe.Automaton(json.loads(bpe.load_spec(tokenizer_path()))), Tokenizer.from_file(tokenizer_path())
    for text in ("a  \n b", "a\n b", "a \n\n b", "a   b", " \n", "\n", "  ", " ", "a b\nc", "x \tb", "\t"):
        assert a.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_splits_as_the_library_at_every_code_point():
    from tokenizers import pre_tokenizers

    ours, theirs = bpe.Automaton({"model": {"vocab": {}, "merges": []}}), pre_tokenizers.ByteLevel(add_prefix_space=False)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        text = "a{0}1{0}!{0} {0}".format(chr(c))
        assert list(itertools.accumulate(map(len, ours.words(text)))) == [end for _, (_, end) in theirs.pre_tokenize_str(text)], hex(c)


def test_bpe_of_letters_newer_than_the_library():
    from tokenizers import Tokenizer

    a, t = bpe.Automaton(json.loads(bpe.load_spec(tokenizer_path()))), Tokenizer.from_file(tokenizer_path())
    rng, newer = random.Random(11), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and a.later(chr(c))]
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(newer), chr(rng.randrange(32, 127)), " ", "\n", chr(rng.randrange(0xD800))]) for _ in range(rng.randrange(40)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert a.encode(text).tolist() == ids and a.decode(ids) == t.decode(ids, skip_special_tokens=False), text


def test_bpe_keeps_a_word_once_whatever_mark_follows():
    """A word in a text's memory is not there again with each mark behind it, nor are ends of two lines."""
    from tokenizers import Tokenizer

    a, t = bpe.Automaton(json.loads(bpe.load_spec(tokenizer_path()))), Tokenizer.from_file(tokenizer_path())
    texts = ["so ndtionth, ndtionth. ndtionth; ndtionth ndtionth! end.\nNext ndtionth? : x,", "é ش. ش٣. don't, ..., a.. ำ."]
    for text in texts:
        assert a.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    a.memory.clear()
    a.encode(texts[0])
    assert "ndtionth" in a.memory and not any(k[:-1].strip().isalpha() and k[-1] in ".,;:!?" or "\n" in k.strip() for k in a.memory)


def test_bpe_decodes_many_texts_at_once():
    a = bpe.Automaton(json.loads(bpe.load_spec(tokenizer_path())))
    texts = ["", "a b", "\U00010348", "é ش٣", ""]
    ids = [a.encode(x) for x in texts]
    half = a.encode("\U00010348")[:1]  # no whole character
    for parts in (ids, [*ids, half, ids[1]], [ids[0]]):
        bounds = [0]
        for x in parts:
            bounds.append(bounds[-1] + len(x))
        assert a.decoded(np.concatenate(parts), np.array(bounds)).to_pylist() == [a.decode(x.tolist()) for x in parts]
