"""DuckDB SQL for the queries, or the parts of them, that SQL can express.

op6, op7 and op10 to op13 are expressed whole. Of op1, op3, op5, op8 and op9 only the columns of ``mix_targets``,
``bpe_round_trip``, ``suffix_passages``, ``winnow_edits`` and ``language_folds`` are; permutations, token ids,
other holders of a passage, fingerprints and compressed sizes are not, nor are op2 and op4. ``tests/llm`` holds
those against plain Python.
"""

from __future__ import annotations

from . import archives, licences, minhash, quality, vectors

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLES: dict[str, str] = {}

_ORACLES["mix_targets"] = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS total, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
 x AS (SELECT 0 AS round, source, total, weight, FALSE AS capped FROM s
   UNION ALL SELECT round + 1, source, total, weight, capped OR 3 * total <= weight * (sum(total) OVER () - coalesce(sum(3 * total) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () FROM x WHERE round < 30),
 t AS (SELECT source, total, CASE WHEN capped THEN (3 * total)::DOUBLE ELSE weight * (sum(total) OVER () - coalesce(sum(3 * total) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () END AS target FROM x WHERE round = 30)
 SELECT doc_id, size, total AS source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

_ORACLES["bpe_round_trip"] = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

_ORACLES["suffix_passages"] = f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents WHERE text IS NOT NULL),
 x AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50), g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM x),
 p AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
 n AS (SELECT *, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT, 1) AS fresh FROM p), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n)
 SELECT doc_id, min(i) AS first_word, max(i) + 50 - min(i) AS n_words FROM r GROUP BY doc_id, run"""

_ORACLES["winnow_edits"] = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
 x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC)) AS follows FROM d)
 SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 3) || left(follows, n // 3)) AS edited_sha256 FROM x"""



def _crc(number: str) -> str:
    """CRC-32 of a decimal number, a bit at a time: each byte is followed by seven zeros, and every step shifts once."""
    bits = f"list_concat([4294967295], flatten(list_transform(string_split({number}::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [0, 0, 0, 0, 0, 0, 0]))))"
    return f"xor(list_reduce({bits}, lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"


# CRC-32, a bit at a time: each byte is followed by seven zeros, and every step shifts once
_ORACLES["language_folds"] = r"""WITH s AS (SELECT doc_id, text, list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [0, 0, 0, 0, 0, 0, 0])))) AS bits FROM documents)
 SELECT doc_id, xor(list_reduce(bits, lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS undetermined FROM s"""


def _pattern(tree: list[tuple]) -> str:
    """A template as a regular expression over words that a blank follows each."""
    out = ""
    for kind, x in tree:
        out += f"{x.decode()} " if kind == "word" else f"([^ ]+ ){{0,{x}}}" if kind == "any" else f"({_pattern(x)})?"
    return out


def _licences() -> str:
    words = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    found = []
    for phrase, label in licences.PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{x.decode()}'" for k, x in enumerate(licences.words(phrase), start=1))
        found.append(f"list_transform(list_filter(range(0, len(w)), lambda i: coalesce({same}, FALSE)), lambda i: {{'i': i, 'label': '{label}'}})")
    matched = ", ".join(f"CASE WHEN regexp_matches(t, ' {_pattern(licences.parsed(x))}') THEN '{label}' END" for label, x in licences.TEMPLATES.items())
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
 b AS (SELECT doc_id, len(w) AS n_words, flatten([{", ".join(found)}]) AS base, list_filter([{matched}], lambda x: x IS NOT NULL) AS templates FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d)),
 l AS (SELECT *, list_sort(list_distinct(list_transform(base, lambda x: x.label))) AS known FROM b)
 SELECT doc_id, n_words, len(base) AS n_base, list_min(list_transform(base, lambda x: x.i)) AS first_word, list_max(list_transform(base, lambda x: x.i)) AS last_word, array_to_string(known, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(known, templates))), ',') AS labels, CASE WHEN len(templates) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM l"""


_ORACLES["op6_licences"] = _licences()

_ORACLES["op7_minhash"] = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {minhash.PERCENT} * (x.n + y.n - shared)),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), low AS (SELECT a, least(a, min(b)) AS comp FROM reach GROUP BY a)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON a = d.doc_id"""


def _count(pattern: str) -> str:
    return "(length(t) - length(regexp_replace(t, '" + pattern.replace("'", "''") + "', '', 'g')))"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    m = f"(({p})[i] + ({q})[i]) / 2"
    part = lambda x: f"CASE WHEN ({x})[i] > 0 THEN ({x})[i] * log2(({x})[i] / ({m})) ELSE 0 END"
    return f"sqrt(greatest(0, least(1, coalesce(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(p)} + {part(q)}) / 2)), 0))))"


def _quality() -> str:
    classes = ", ".join(f"{_count(c)}::DOUBLE" for c in quality.CLASSES)
    symbols, spaces = _count(quality.SYMBOLS), _count(_SPACE)
    repeat = quality.REPEAT
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, coalesce(text, '') AS t FROM documents),
 k AS (SELECT *, [{classes}] AS part, regexp_extract_all(lower(t), '{quality.LETTERS}') AS v, regexp_extract_all(t, '{_WORD}') AS w FROM d),
 e AS (SELECT *, list_append(part, length(t) - list_sum(part)) AS counts, len(w) AS n_words FROM k),
 u AS (SELECT lang AS l, md5(concat(coalesce(doc_id::VARCHAR, ''), '-', text)) AS h, any_value(counts) AS counts, any_value(v) AS v FROM e WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY l, h),
 f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY l ORDER BY h) <= {quality.SAMPLE}),
 cr AS (SELECT l, list(n / greatest(total, 1) ORDER BY i) AS ref FROM (SELECT l, i, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY l) AS total FROM (SELECT l, unnest(counts) AS n, unnest(range(0, {len(quality.CLASSES) + 1})) AS i FROM f) GROUP BY l, i) GROUP BY l),
 lead AS (SELECT l, w, n, sum(n) OVER (PARTITION BY l) AS total, row_number() OVER (PARTITION BY l ORDER BY n DESC, w) AS place FROM (SELECT l, w, count(*) AS n FROM (SELECT l, unnest(v) AS w FROM f) GROUP BY l, w)),
 ws AS (SELECT DISTINCT w FROM lead WHERE place <= {quality.COMMON_WORDS}), wl AS (SELECT list(w ORDER BY w) AS words FROM ws),
 wr AS (SELECT l, list_append(r, greatest(0, 1 - list_sum(r))) AS ref FROM (SELECT a.l, list(coalesce(n / total, 0) ORDER BY ws.w) AS r FROM (SELECT DISTINCT l FROM f) a CROSS JOIN ws LEFT JOIN lead ON lead.l = a.l AND lead.w = ws.w GROUP BY a.l)),
 share AS (SELECT rid, len(v) AS n, list_transform(counts, lambda x: x / greatest(length(t), 1)) AS cs, list_transform(words, lambda x: len(list_filter(v, lambda y: y = x)) / greatest(len(v), 1)) AS r FROM e CROSS JOIN wl),
 whole AS (SELECT rid, n, cs, list_append(r, 1.0 * (n - round(list_sum(r) * greatest(n, 1))) / greatest(n, 1)) AS ss FROM share),
 far AS (SELECT rid, any_value(n) AS n, (SELECT min({_distance("cs", "ref")}) FROM cr) AS cd, (SELECT min({_distance("ss", "ref")}) FROM wr) AS wd FROM whole GROUP BY rid, cs, ss),
 fence AS (SELECT coalesce(quantile_cont(x, 0.75) + {quality.FENCE} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 0) AS fence FROM (
   SELECT wd * sqrt(n) AS x FROM far JOIN e USING (rid) JOIN f ON f.l = lang AND f.h = md5(concat(coalesce(doc_id::VARCHAR, ''), '-', text)) WHERE n >= {quality.LEAST_WORDS})),
 g AS (SELECT rid, i, array_to_string(w[i:i + {repeat - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, n_words - {repeat - 2})) AS i FROM e WHERE n_words >= {repeat})),
 rep AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {repeat})) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS found FROM g) WHERE found > 1) GROUP BY rid),
 b AS (SELECT doc_id, n_words, length(t) - {spaces} AS word_chars, {symbols} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, cd, wd, n, fence
   FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM e) JOIN far USING (rid) LEFT JOIN rep USING (rid) CROSS JOIN fence),
 j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND NOT (n_words >= {quality.LEAST_WORDS} AND (cd > {quality.FAR_CLASSES} OR wd > greatest({quality.FAR_WORDS}, fence / sqrt(greatest(n, 1))))) AS kept FROM j"""


_ORACLES["op10_quality"] = _quality()
_ORACLES["quality_fitted"] = _ORACLES["op10_quality"].replace(f" QUALIFY row_number() OVER (PARTITION BY l ORDER BY h) <= {quality.SAMPLE}", "")

# the first turns of the hundred's first conversation and one's own behind them, as lists of which prefixes are nodes
_ORACLES["op11_trie"] = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS own, ({_crc("c")} % 6)::INT AS h FROM t GROUP BY c),
 r AS (SELECT l.c, list_concat(coalesce(b.own, [])[1:l.h], l.own[l.h + 1:]) AS seq FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
 p AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r), k AS (SELECT c, depth, len(seq) = depth AS ended, md5(seq[1:depth]::VARCHAR || depth) AS key, md5(seq[1:depth - 1]::VARCHAR || (depth - 1)) AS above, CASE WHEN depth > 0 THEN length(seq[depth].text) ELSE 0 END AS chars FROM p),
 n AS (SELECT key, depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM k GROUP BY key, depth),
 ch AS (SELECT above AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS own FROM n LEFT JOIN ch USING (key, depth)),
 s AS (SELECT k.key, k.depth, sum(f.own)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM f JOIN k ON k.c = f.conv_id AND k.depth <= f.depth GROUP BY ALL)
 SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s USING (key, depth) LEFT JOIN n u ON u.key = f.above AND u.depth = f.depth - 1 AND f.depth > 0"""


def _vectors() -> str:
    """Lloyd's rounds by full scans: squares of whole numbers, which are exact as doubles."""
    finite = "list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))"
    steps = [f"""k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({vectors.SCALE} * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len({finite}) = 0),
 v AS MATERIALIZED (SELECT rid, vec_id, part, x[part * (len(x) // {vectors.PARTS}) + 1:(part + 1) * (len(x) // {vectors.PARTS})] AS x FROM k, range({vectors.PARTS}) r(part)),
 b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS y FROM v WHERE vec_id IN (SELECT DISTINCT vec_id FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {vectors.ENTRIES}))"""]
    for i in range(vectors.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, part, m[2]::INT AS e, m[1] AS d FROM (SELECT rid, v.part, min([list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y), e]) AS m FROM v JOIN b{i} USING (part) GROUP BY ALL))""")
        if i < vectors.ROUNDS:
            steps.append(f"""m{i} AS (SELECT part, e, i, floor(sum(x) / count(*)) AS y FROM (SELECT part, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{i} JOIN v USING (rid, part)) GROUP BY ALL),
 b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.y, b.y) AS y FROM b{i} b LEFT JOIN (SELECT part, e, list(y ORDER BY i) AS y FROM m{i} GROUP BY ALL) n USING (part, e))""")
    last = vectors.ROUNDS
    return f"""WITH {", ".join(steps)},
 c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY rid),
 g AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT::VARCHAR), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{last})
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (rid) CROSS JOIN g"""


_ORACLES["op12_vectors"] = _vectors()

_ORACLES["op13_archives"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {archives.LEAST_BYTES} AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {archives.LEAST_BYTES} AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM q"""

ORACLES = _ORACLES
