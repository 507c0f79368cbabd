"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their check are permuted within their format by a keyed Feistel network, so
the same value gets the same pseudonym in every document: card numbers (Luhn, and valid again
afterwards), bank accounts (IBAN, modulo 97, with new check digits; country and letters stay), phone numbers
with a country code, behind 00 or a national 0 (a number written in these ways stays one number), social
security numbers, IPv4 addresses, dates of 1800 to 2199 in figures and with English months. Mail addresses,
IPv6 addresses and long hexadecimal secrets get keyed digests in their format. All else stays as it is.

The network has two halves with moduli of their own and adds a keyed SHA-256 of one half to the other
modulo its size, so every domain that is a product of two numbers needs no cycle walking: 10^u * 10^v for
digits, 2^16 * 2^16 for addresses, 189 * 773 for the 146,097 days of 400 years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that holds the key of a deployment.
KEY_SETTING = "spark.corpusframe.privacy.key"
#: The country codes of telephone numbers, of one, two or three digits.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: The lengths of bank account numbers (IBAN) by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What may be private, by kind; every pattern takes a whole token, and none can backtrack over a long run.
PATTERNS = {
    "iban": "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{x.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, x in IBANS.items()) + ")(?![A-Za-z0-9])",
    "address6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?<=[0-9A-Fa-f]{1,4}:{1,2}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])(?!\.[0-9])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z0-9-]{2,63})",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3} ?\([0-9]{1,4}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])(?!\.[0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9+.,/-])00[1-9][0-9]{0,2}[ /-](?:\([0-9]{1,4}\)[ /-]?)?[0-9]{1,5}(?:[ /-]?[0-9]{2,8}){1,3}(?![0-9])(?![.,][0-9])|(?<![0-9+.,/-])(?:\(0[1-9][0-9]{1,4}\)[ /-]?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,8}(?:[ /-][0-9]{2,6}){0,2}(?![0-9])(?![.,][0-9])",
    "address": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "date": rf"(?<![0-9/.-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}} (?:{MONTHS}) [0-9]{{4}})(?![0-9])(?![/.-][0-9])|(?<![0-9A-Za-z])(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9])",
}
#: The usual groupings of card numbers, with one separator throughout, at every place where one may start.
#: Those with a right check digit are taken before any other grouping, so that no number beside them is taken in.
CARDS = [
    r"(?<![0-9])(?=([0-9]{13,19})(?![0-9]))",
    r"(?<![0-9])(?=([0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3})(?![0-9]))",
    r"(?<![0-9])(?=([0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9]))",
    r"(?<![0-9])(?=([0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9]))",
]
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum of a digit string with its check digit."""
    digit = "cast(substring(d, -i, 1) AS int)"
    return f"aggregate(transform(sequence(1, length({digits})), i -> if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))), 0, (a, x) -> a + x)".replace("substring(d,", f"substring({digits},")


def _mod97(number: str) -> str:
    """SQL for an account number with its country and check digits behind it, letters as numbers, modulo 97."""
    plain = f"array_join(transform(split({number}, ''), c -> if(c RLIKE '[A-Z]', cast(ascii(c) - 55 AS string), c)), '')"
    return f"aggregate(regexp_extract_all({plain}, '[0-9]{{1,9}}', 0), 0L, (a, c) -> cast(concat(a, c) AS bigint) % 97)"


def _filled(form: str, digits: str) -> str:
    """SQL for a text with its digits replaced by others, one after another."""
    return f"array_join(transform(sequence(1, length({form})), i -> if(substring({form}, i, 1) RLIKE '[0-9]', substring({digits}, length(regexp_replace(left({form}, i), '[^0-9]', '')), 1), substring({form}, i, 1))), '')"


#: An IPv6 address with all its groups, four digits each.
_SIDE = "filter(split(lower(split(x.m, '::')[{}]), ':'), g -> g <> '')"
_ADDRESS6 = f"if(x.m LIKE '%::%', array_join(transform(concat({_SIDE.format(0)}, array_repeat('0', 8 - size({_SIDE.format(0)}) - size({_SIDE.format(1)})), {_SIDE.format(1)}), g -> lpad(g, 4, '0')), ':'), array_join(transform(split(lower(x.m), ':'), g -> lpad(g, 4, '0')), ':'))"
_ACCOUNT = "replace(x.m, ' ', '')"
#: What stays in front of a phone number's permuted digits: a country code, 00 and one, or a national 0.
_PREFIX = f"CASE WHEN x.m LIKE '+%' THEN regexp_extract(x.d, {_sql(COUNTRY)}, 0) WHEN x.m LIKE '00%' THEN concat('00', regexp_extract(substring(x.d, 3), {_sql(COUNTRY)}, 0)) WHEN x.m RLIKE '^[(]?0' THEN '0' ELSE '' END"
#: How a date is written, in the order in which its formats are tried.
_WRITTEN = [("x.m LIKE '____-%'", ["yyyy-MM-dd"]), ("x.m RLIKE '^[0-9]+ [A-Z][a-z]{2} '", ["d MMM yyyy"]), ("x.m RLIKE '^[0-9]+ [A-Z]'", ["d MMMM yyyy"]), ("x.m RLIKE '^[A-Z][a-z]{2} '", ["MMM d, yyyy"]), ("x.m RLIKE '^[A-Z]'", ["MMMM d, yyyy"]),
    ("x.m RLIKE '^[0-9]{2}/[0-9]{2}/'", ["dd/MM/yyyy", "MM/dd/yyyy"]), ("x.m LIKE '%/%'", ["d/M/yyyy", "M/d/yyyy"]), ("x.m RLIKE '^[0-9]{2}[.][0-9]{2}[.]'", ["dd.MM.yyyy", "MM.dd.yyyy"]), ("true", ["d.M.yyyy", "M.d.yyyy"])]
_READ = "CASE " + " ".join(f"WHEN {c} THEN coalesce({', '.join(f'try_to_date(x.m, {_sql(f)})' for f in fs)})" for c, fs in _WRITTEN) + " END"


def _written(date: str) -> str:
    """SQL for a date in the way in which ``x.m`` writes one."""
    one = lambda f: f"date_format({date}, {_sql(f)})"
    return "CASE " + " ".join(f"WHEN {c} THEN {one(fs[0]) if len(fs) == 1 else f'if(try_to_date(x.m, {_sql(fs[0])}) IS NULL, {one(fs[1])}, {one(fs[0])})'}" for c, fs in _WRITTEN) + " END"


def _private(key: str) -> str:
    """SQL over the array of matches ``_found``: the replacement of each, null where it stays."""
    k = _sql(key)
    kind = "CASE " + " ".join(f"WHEN m RLIKE {_sql('^(?:' + p.replace('(?<![0-9A-Za-z])', '') + ')$')} THEN '{n}'" for n, p in PATTERNS.items()) + " END"
    steps = [
        f"transform(_found, m -> struct(m AS m, {kind} AS kind, regexp_replace(m, '[^0-9]', '') AS d))",
        # the digits that are permuted; a date's day number; null where a check fails
        f"""transform(@, x -> struct(x.m AS m, x.kind AS kind, CASE x.kind
            WHEN 'card' THEN if({_luhn('x.d')} % 10 = 0, left(x.d, length(x.d) - 1), NULL)
            WHEN 'phone' THEN if(length(x.d) BETWEEN 8 AND 15, substring(x.d, length({_PREFIX}) + 1), NULL)
            WHEN 'iban' THEN if({_mod97(f"concat(substring({_ACCOUNT}, 5), left({_ACCOUNT}, 4))")} = 1, nullif(substring(x.d, 3), ''), NULL)
            WHEN 'ssn' THEN x.d END AS d,
            CASE WHEN x.kind = 'date' THEN datediff({_READ}, DATE'1800-01-01') END AS day,
            CASE WHEN x.kind = 'address' THEN transform(split(x.m, '\\\\.'), o -> cast(o AS bigint)) END AS o))""",
        """transform(@, x -> struct(x.m AS m, x.kind AS kind, length(x.d) AS n,
            CASE x.kind WHEN 'address' THEN 65536L WHEN 'date' THEN 189L ELSE cast(power(10, length(x.d) div 2) AS bigint) END AS ml,
            CASE x.kind WHEN 'address' THEN 65536L WHEN 'date' THEN 773L ELSE cast(power(10, length(x.d) - length(x.d) div 2) AS bigint) END AS mr,
            CASE x.kind WHEN 'address' THEN x.o[0] * 256 + x.o[1] WHEN 'date' THEN if(x.day BETWEEN 0 AND 146096, x.day div 773, NULL)
                ELSE cast(left(x.d, cast(length(x.d) div 2 AS int)) AS bigint) END AS l,
            CASE x.kind WHEN 'address' THEN x.o[2] * 256 + x.o[3] WHEN 'date' THEN cast(x.day % 773 AS bigint)
                ELSE cast(right(x.d, cast(length(x.d) - length(x.d) div 2 AS int)) AS bigint) END AS r))""",
    ]
    for i in range(ROUNDS):
        to, by, size = ("l", "r", "ml") if i % 2 == 0 else ("r", "l", "mr")
        add = f"cast(conv(left(sha2(concat_ws('|', {k}, x.kind, x.n, {i}, x.{by}), 256), 15), 16, 10) AS bigint)"
        new = {"l": "x.l", "r": "x.r"} | {to: f"pmod(x.{to} + {add}, x.{size})"}
        steps.append(f"transform(@, x -> struct(x.m AS m, x.kind AS kind, x.n AS n, x.ml AS ml, x.mr AS mr, {new['l']} AS l, {new['r']} AS r))")
    new = "concat(lpad(cast(x.l AS string), cast(x.n div 2 AS int), '0'), lpad(cast(x.r AS string), cast(x.n - x.n div 2 AS int), '0'))"
    digest = lambda what, n: f"left(sha2(concat_ws('|', {k}, {what}), 256), {n})"
    steps += [
        f"transform(@, x -> struct(x.m AS m, x.kind AS kind, x.l AS l, x.r AS r, CASE WHEN x.kind = 'card' THEN {new} WHEN x.kind = 'phone' THEN concat({_PREFIX.replace('x.d', "regexp_replace(x.m, '[^0-9]', '')")}, {new}) WHEN x.kind IN ('ssn', 'iban') THEN {new} END AS d))",
        # the last digit that makes a card number valid
        f"transform(@, x -> struct(x.m AS m, x.kind AS kind, x.l AS l, x.r AS r, CASE x.kind WHEN 'card' THEN concat(x.d, cast((10 - {_luhn('concat(x.d, 0)')} % 10) % 10 AS string)) WHEN 'iban' THEN {_filled(f'substring({_ACCOUNT}, 5)', 'x.d')} ELSE x.d END AS d))",
        f"transform(@, x -> struct(x.m AS m, x.kind AS kind, x.l AS l, x.r AS r, if(x.kind = 'iban', concat(left(x.m, 2), lpad(cast(98 - {_mod97("concat(x.d, left(x.m, 2), '00')")} AS string), 2, '0'), x.d), x.d) AS d))",
        f"""transform(@, x -> CASE
            WHEN x.kind = 'address6' THEN regexp_replace({digest("'address6', " + _ADDRESS6, 32)}, '([0-9a-f]{{4}})(?=[0-9a-f])', '$1:')
            WHEN x.kind = 'mail' THEN concat('u', {digest("'mail', lower(x.m)", 12)}, '@m', {digest("'host', lower(substring_index(x.m, '@', -1))", 8)}, '.example')
            WHEN x.kind = 'secret' THEN if(x.m = lower(x.m), left(concat({digest("'a', lower(x.m)", 64)}, {digest("'b', lower(x.m)", 64)}), length(x.m)), upper(left(concat({digest("'a', lower(x.m)", 64)}, {digest("'b', lower(x.m)", 64)}), length(x.m))))
            WHEN x.l IS NULL THEN NULL
            WHEN x.kind = 'address' THEN concat_ws('.', x.l div 256, x.l % 256, x.r div 256, x.r % 256)
            WHEN x.kind = 'date' THEN {_written("date_add(DATE'1800-01-01', cast(x.l * 773 + x.r AS int))")}
            WHEN x.kind = 'iban' THEN array_join(transform(sequence(1, length(x.m)), i -> if(substring(x.m, i, 1) = ' ', ' ', substring(x.d, length(replace(left(x.m, i), ' ', '')), 1))), '')
            ELSE {_filled('x.m', 'x.d')} END)""",
    ]
    out = steps[0]
    for s in steps[1:]:
        out = s.replace("@,", out + ",", 1)
    return out


def _patterns(text: str) -> str:
    """SQL for the pattern of a text: all kinds, and before them the valid card numbers it holds in a usual grouping."""
    found = ", ".join(f"regexp_extract_all(`{text}`, {_sql(p)}, 1)" for p in CARDS)
    digits = "regexp_replace(c, '[^0-9]', '')"
    valid = f"filter(array_distinct(concat({found})), c -> {_luhn('@').replace('@', digits)} % 10 = 0)"
    apart = PATTERNS["card"].replace("[ -]?", "(?:[ -](?!(?:@)(?![0-9])))?")
    head, tail = apart.split("@")
    rest = "|".join(f"(?:{p})" for n, p in PATTERNS.items() if n != "card")
    one = f"transform(array(array_join({valid}, '|')), v -> if(v = '', {_sql(_ANY)}, concat('(?<![0-9])(?:', v, ')(?![0-9])|', {_sql(rest + '|(?:' + head)}, v, {_sql(tail + ')')})))[0]"
    return f"if(`{text}` RLIKE {_sql('[0-9](?:[ -]?[0-9]){12}')}, {one}, {_sql(_ANY)})"


def pseudonymized(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The documents with private values in ``text`` replaced; all other columns stay, whatever their names.

    The network can be undone with the ``key``, so a deployment keeps it secret. ``count`` names a column for
    the number of values replaced (in place of one of that name). A null text stays null with 0, empty texts and
    those without private values stay as they are, rows that repeat stay equal, texts of any length are read
    whole. An empty table gives an empty one.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text}`").alias("_text"))
    may = F.col("_text").rlike("[0-9@]|[a-fA-F]{32}|::")
    df = df.withColumn("_any", F.expr(_patterns("_text"))).withColumn("_found", F.when(may, F.regexp_extract_all("_text", F.col("_any"), F.lit(0))))
    df = df.withColumn("_new", F.when(F.size("_found") > 0, F.expr(_private(key))))
    joined = F.expr("array_join(zip_with(split(_text, _any, -1), zip_with(_new, _found, (n, o) -> coalesce(n, o)), (g, n) -> concat(g, coalesce(n, ''))), '')")
    replaced = F.coalesce(F.expr("size(filter(_new, n -> n IS NOT NULL))"), F.lit(0))
    columns = [F.when(F.col("_new").isNotNull(), joined).otherwise(F.col("_text")).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns if c != count]
    if count:
        columns.append(F.when(F.col("_new").isNotNull(), replaced).otherwise(0).cast("long").alias(count))
    return df.select(columns)
