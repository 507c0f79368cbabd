"""Prefix tries, vector codes and web archives against plain Python versions."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import archives, tries, vectors

TURNS = "conv_id long, turn long, role string, text string, depth long, n_convs string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)


def trie_rows(rows):
    """The contract of op11, one prefix after another."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = lambda v: [x for x in members if len(x) == len(v) + 1 and x[: len(v)] == v]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children(node)), sum(not children(x) for x in below), saved, digest))
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def many_turns(seed, n=60):
    pick = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 101, 150, -3, -104, 5000]:
        turns = pick.choice([1, 2, 3, 5, 8, 14])
        shared = pick.random() < 0.6
        rows += [(c, t, "user" if t % 2 else "assistant", "abcdef"[: 1 + t % 5] if shared and t < 9 else f"{c % 7}-{t}-é") for t in range(turns)]
    rows += [(7, None, None, None), (7, None, "a", "first"), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (8, 3, None, "tie"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize(("shard_nodes", "bits"), [(200_000, 12), (3, 12), (4, 2)])
def test_tries_equal_brute_force(spark, monkeypatch, shard_nodes, bits):
    """Whole tries, tries cut into many shards below upper levels, and conversations followed in pieces."""
    monkeypatch.setattr(tries, "PIECE_BITS", bits)
    monkeypatch.setattr(tries, "LADDER", [1 << i for i in range(bits)])
    rows = many_turns(bits)
    assert found(tries.prefix_trie(conversations(spark, rows), shard_nodes)) == trie_rows(rows)


def test_tries_of_odd_tables(spark):
    assert found(tries.prefix_trie(conversations(spark, [(1, 0, "user", "x")]).limit(0))) == []
    for rows in ([(None, 1, "a", "b")], [(5, 0, None, None)], [(101, t, "user", "y" * 30_000) for t in range(3)], [(c, t, "user", f"{t}") for c in range(300, 340) for t in range(7)]):
        assert found(tries.prefix_trie(conversations(spark, rows), 5)) == trie_rows(rows)


def test_one_of_many_equal_conversations(spark):
    """A group of copies is one path; a conversation that many begin like has one task's worth of rows."""
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(6)] + [(2000 + c, t, "user", "t0" if t == 0 else f"{c}") for c in range(50) for t in range(3)]
    assert found(tries.prefix_trie(conversations(spark, rows), 10)) == trie_rows(rows)


def test_louds_bits():
    #       a: b, c; b: d, and a second root e
    trie = tries.Louds(np.array([-1, 0, 0, 1, -1]), np.array([0, 1, 1, 2, 0]), np.array([5, 6, 7, 8, 9]))
    assert trie.bits.tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0] and trie.labels.tolist() == [5, 9, 6, 7, 8]
    assert trie.parents().tolist() == [0, 0, 1, 1, 3] and trie.degrees().tolist() == [2, 2, 0, 1, 0, 0]
    members, least, leaves, saved = tries.rolled(trie, np.array([0, 1, 2, 3, 1]), np.array([99, 4, 3, 2, 1]), np.array([1, 10, 100, 1000, 5]))
    assert members.tolist() == [7, 6, 1, 4, 2, 3] and least.tolist() == [1, 2, 1, 2, 3, 2]
    assert leaves.tolist() == [3, 2, 1, 1, 1, 1] and saved.tolist() == [2135, 2135, 0, 2030, 100, 2000]


# --- vectors ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def vector_rows(rows, rounds=4):
    """The contract of op12 by full scans of Python numbers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], None
    w = max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    kept = [(i, v + [0] * (4 * w - len(v)), lab) for i, v, lab in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[:256]] or [[0] * 4 * w]
    books = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(4)]
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(p, x[p])[1] for p in range(4)] for x in cut]
        new = []
        for p in range(4):
            held = {}
            for c, x in zip(codes, cut, strict=True):
                held.setdefault(c[p], []).append(x[p])
            new.append([[sum(y) // len(held[k]) for y in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])])
        books = new
    last = [[nearest(p, x[p]) for p in range(4)] for x in cut]
    errors = [sum(d for d, _ in r) for r in last]
    labels = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in r), e, labels[lab], digest) for (i, _, lab), r, e in zip(kept, last, errors, strict=True)), key=str), digest


def coded(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectors.digests(df).collect()), key=str)


def test_vector_codes_equal_full_scans(spark):
    pick = random.Random(2)
    rows = [(i * 3, [pick.gauss(0, 0.2) for _ in range(12)], pick.choice([None, 1, 2])) for i in range(400)]
    rows += [(9000 + i, list(rows[5][1]), 2) for i in range(40)]  # a very common vector
    rows += [(1, [0.1] * 12, None), (2, [float(pick.randint(-2, 2)) / 4 for _ in range(12)], 3), (4, [float("nan")] * 12, 1), (5, None, 1), (7, [0.1, None] * 6, 1), (8, [float("inf")] * 12, 1)]
    assert coded(spark.createDataFrame([(*r, "x") for r in rows], VECTORS)) == vector_rows(rows)[0]


def test_equally_near_entries_and_odd_vectors(spark):
    """Ties go to the lower entry; repeated and null keys, other lengths, few rows, empty tables."""
    grid = [(i, [float(i % 4), 0.0, float(i % 3), 1.0], i % 2) for i in range(30)]
    odd = [(3, [0.5, 0.25], None), (3, [0.5, 0.25], None), (None, [1.0] * 4, 1), (99, [], 4), (4, [2.0] * 7, None)]
    for rows in (grid, odd, [(None, [1.0, 2.0], None)], [(1, None, 1)]):
        assert coded(spark.createDataFrame([(*r, "x") for r in rows], VECTORS)) == vector_rows(rows)[0]
    assert coded(spark.createDataFrame([], VECTORS)) == []


def test_bounds_spare_scans_and_hold():
    """Wherever bounds decide, a full scan finds the same; settled rounds scan few rows."""
    draw = np.random.default_rng(4)
    centres = draw.integers(-900, 900, (40, 8))
    x = centres[draw.integers(0, 40, 5000)] + draw.integers(-30, 30, (5000, 8))
    book = x[:64].copy()
    code, upper, lower = vectors.assigned(x, book)
    scanned = []
    for _ in range(6):
        new = np.stack([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(64)])
        moves, book = vectors.Moves(book[None], new[None]), new
        code, upper, lower, n = vectors.reassigned(x, book, moves, 0, code, upper, lower)
        assert (code == vectors.assigned(x, book)[0]).all()
        scanned.append(n)
    assert scanned[-1] < 1500


def test_squares_beyond_doubles_are_exact():
    x, book = np.array([[vectors.LARGEST, -vectors.LARGEST + 1] * 8]), np.array([[-vectors.LARGEST, 3] * 8, [vectors.LARGEST, -vectors.LARGEST] * 8])
    assert vectors._squares(x, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], e, strict=True)) for e in book]]


# --- archives ---------------------------------------------------------------------------------------------

HTML = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def arc(version, records):
    """An ARC archive of (url, date, mime, block)."""
    about = f"{version} 0 test\n{' '.join(archives.FIELDS[version])}\n".encode()
    extra = "200 - - 0 f.arc " if version == 2 else ""
    out = f"filedesc://f.arc 0.0.0.0 20010102030405 text/plain {extra}{len(about)}\n".encode() + about + b"\n"
    for url, date, mime, block in records:
        out += f"{url} 1.2.3.4 {date} {mime} {extra}{len(block)}\n".encode() + block + b"\n"
    return out


RECORDS = [("http://a/b c", "19990102030405", "text/html", HTML + b"one\n\nWARC/1.0\r\ntwo"), ("dns:a", "199901020304", "text/dns", b"a 1.2.3.4"), ("http://a/", "1999", "text/html", HTML)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_of_both_versions(version):
    plain = arc(version, RECORDS)
    members = b"".join(gzip.compress(x) for x in (plain[:50], plain[50:90], plain[90:]))
    for content in (plain, gzip.compress(plain), members):
        got = [(t["URL"], t["Archive-date"], t["Content-type"], b) for t, b in archives.arc_records(content)]
        assert got[1:] == RECORDS and got[0][0] == "filedesc://f.arc"
    # joined archives: each version block tells the fields behind it; a record that is cut off has what is left
    got = [(t["URL"], b) for t, b in archives.arc_records(arc(1, RECORDS[:1]) + arc(2, RECORDS[1:]))]
    assert [x for x in got if not x[0].startswith("filedesc")] == [(u, b) for u, _, _, b in RECORDS]
    assert [b for _, b in archives.arc_records(plain[:-5])][-1] == HTML[:-4]


def test_converted_records():
    warcinfo, page, dns, bare = (archives.converted(*r) for r in archives.arc_records(arc(1, RECORDS)))
    assert [x[3] for x in (warcinfo, page, dns, bare)] == ["warcinfo", "response", "resource", "response"]
    assert [x[2] for x in (page, dns, bare)] == ["1999-01-02T03:04:05Z", "1999-01-02T03:04:00Z", "1999-01-01T00:00:00Z"]
    assert page[6:9] == (18, hashlib.sha1(b"one\n\nWARC/1.0\r\ntwo").hexdigest(), hashlib.sha1(RECORDS[0][3]).hexdigest())
    assert bare[6] == 0 and len({x[9] for x in (warcinfo, page, dns, bare)}) == 4
    assert page == archives.converted(*list(archives.arc_records(arc(1, RECORDS)))[1])


def test_archives_on_disk_become_warc(spark, tmp_path):
    """ARC files, one of them gzipped, are read, converted, written and read back record by record."""
    (tmp_path / "arc").mkdir()
    body = b"\x00\xff\xfe" + b"z" * 1500
    keyed = lambda k: HTML[:-2] + f"{archives.KEY_HEADER}: {k}\r\n\r\n".encode() + body
    (tmp_path / "arc/a.arc").write_bytes(arc(1, RECORDS))
    (tmp_path / "arc/b.arc.gz").write_bytes(gzip.compress(arc(2, [("http://x/1", "20000101000000", "text/html", keyed(1)), ("http://x/2", "20000101000000", "text/html", keyed(2))])))
    files = spark.read.format("binaryFile").load(str(tmp_path / "arc"))
    archives.write(archives.with_revisits(archives.records(files), archives.records(files, blocks=False)), str(tmp_path / "warc"))
    got = sorted((str(r.key), r.type, r.payload_bytes, r.payload_digest, r.refers_to) for r in archives.read(spark, str(tmp_path / "warc")).collect())
    sha = hashlib.sha1(body).hexdigest()
    assert [x for x in got if x[1] not in ("warcinfo", "resource")] == [("1", "revisit", 1503, sha, 2), ("2", "response", 1503, sha, None), *sorted(("None", "response", len(b), hashlib.sha1(b).hexdigest(), None) for b in (b"one\n\nWARC/1.0\r\ntwo", b""))]
    texts = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    assert texts.count(b"WARC-Type: revisit") == 1 and texts.count(body) == 1 and texts.count(b"WARC-Refers-To: <urn:uuid:") == 1
    assert b"WARC-Target-URI: http://a/b c\r\n" in texts and b"Z\r\nWARC-Filename: f.arc\r\n" in texts
    with pytest.raises(ValueError, match="damaged"):
        list(archives.warc_records(texts.replace(b"one\n", b"0ne\n")))


PAGES = "page_id long, url string, html string, content string, type string"


def page_rows(rows):
    held = {}
    for i, _, html in rows:
        held.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        known = [x for x in held[html or ""] if x is not None]
        last = max(known) if known and len(body) >= 1000 else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if last is None or i == last else "revisit", None if last is None or i == last else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [400_000, 0])
def test_pages_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(archives, "BROADCAST_DIGESTS", broadcast)
    long, edge = "é" * 500, "x" * 999
    rows = [(1, "http://a/?q=a b\tc", long), (5, None, long), (3, "", long), (4, "http://d", edge), (9, "http://e", edge), (6, "x" * 5000, None), (7, "http://f", ""), (8, "http://g\n200", "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" + long), (5, None, long), (None, None, long), (None, "http://h", "n" * 2000), (-2, "http://i", "\u0000\U0001f600" * 9), (10, "http://j", "y" * 3_000_000), (12, "filedesc://x 1 2 3 4", "f"), (13, "dns:x", "d"), (11, "http://k", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, "c", "t") for r in rows], PAGES)
    got = archives.archived_pages(df)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == page_rows(rows)
    assert archives.archived_pages(df.limit(0)).count() == 0


def test_parts_of_a_run(spark):
    """Small tasks and batches give what one gives."""
    df = spark.range(300).select((F.col("id") % 40).alias("page_id"), F.lit("http://a").alias("url"), F.repeat(F.lit("ab "), (F.col("id") % 7 * 100).cast("int")).alias("html"))
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    got = archives.archived_pages(df.repartition(7))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == page_rows(rows)
