"""Column functions over bilingual text: normalisation, numbers, citations, titles, paths, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the Arabic script and their plain forms.
HARAKAT = "".join(map(chr, range(0x064B, 0x0653))) + "ٰـ"
ALEF_FORMS = "أإآٱ"
ALEF, ALEF_MAKSURA, YEH = "ا", "ى", "ي"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
DIGITS = "[0-9٠-٩]"
SMALL_WORDS = ["of", "the", "and", "in", "on", "to", "for", "a", "an", "by", "or", "from", "with", "at", "as"]
LIGATURES = {"\ue811": "لمه", "\ue812": "به", "\ue814": "ته", "\ue815": "نه"}
LAM = "ل"
ANSWER_IN = {"ar": "أجب باللغة العربية.", "en": "Answer in English."}
LEVEL_NAMES = {"part": ("Part", "القسم"), "book": ("Book", "الكتاب"), "chapter": ("Chapter", "الباب"), "section": ("Section", "الفصل"), "topic": ("Topic", None)}
ORDINALS_AR = ["الأول", "الثاني", "الثالث", "الرابع", "الخامس", "السادس", "السابع", "الثامن", "التاسع", "العاشر"]


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def once(c, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(_col(c)), use), F.lit(0))


def strip(c, space: str = " \t\n\x0b\f\r") -> Column:
    """Trim any white space, not spaces alone."""
    return F.btrim(_col(c), F.lit(space))


def normalize_ar(c) -> Column:
    """Arabic without vowel marks and stretches, one alef and one yeh (STR-01, STR-02)."""
    return F.translate(_col(c), ALEF_FORMS + ALEF_MAKSURA + HARAKAT, ALEF * len(ALEF_FORMS) + YEH)


def fold_digits(c) -> Column:
    """Arabic-Indic digits to ASCII (STR-03)."""
    return F.translate(_col(c), ARABIC_DIGITS, "0123456789")


def clean_en(c) -> Column:
    """One space between words, none before punctuation (STR-04)."""
    return F.regexp_replace(strip(F.regexp_replace(_col(c), r"\s+", " ")), r" ([,.;:!?])", "$1")


#: A list mark at the start of an Arabic line whose brackets the layout has mirrored, brackets that stand
#: alone, and blanks before marks that none comes before.
LIST_MARK_AR = r"^(?:([٠-٩]+)\s*[()]\s*|[()]\s*([٠-٩]+|[ء-ي]ـ?)\s*[()])"
LONE_AR = r"(?:(?<=\s)|^)[()](?=\s|$)"
NO_BLANK_AR = r"\s+(?=[،.؛:؟!])"


def clean_ar(c) -> Column:
    """White space, ligature glyphs, list marks whose brackets the layout mirrored, stray brackets, and no space
    before punctuation (STR-05)."""
    x = ligatures(strip(F.regexp_replace(_col(c), r"\s+", " ")))
    # a mark at the start of the line: with a bracket on both sides it is (mark), with one behind it is mark)
    bare, closed = F.regexp_extract(x, LIST_MARK_AR, 1), F.regexp_extract(x, LIST_MARK_AR, 2)
    mark = F.when(closed != "", F.concat(F.lit("("), closed, F.lit(")"))).when(bare != "", F.concat(bare, F.lit(") "))).otherwise("")
    rest = F.when(mark != "", F.regexp_replace(x, LIST_MARK_AR, "")).otherwise(x)
    lone = F.regexp_replace(F.concat(mark, rest), LONE_AR, " ")
    return strip(F.regexp_replace(F.regexp_replace(lone, NO_BLANK_AR, ""), r"\s+", " "))


def ligatures(c, glyphs: dict[str, str] | None = None) -> Column:
    """Private-use glyphs to letters (STR-06). One that stands behind a letter and before a space belongs to the
    word after it, as the layout draws it before the space."""
    table = LIGATURES if glyphs is None else glyphs
    c = F.regexp_replace(_col(c), rf"(\S)([{''.join(table)}]) (?=\S)", "$1 $2")
    for glyph, letters in table.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    return c


#: The numbers whose numerals are looked up: those below 90, which need no letter above L.
_NUMERALS = {"X" * (n // 10) + o if n < 40 else ("XL" if n < 50 else "L" + "X" * (n // 10 - 5)) + o: n for n in range(1, 90) for o in [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][n % 10]]}


def roman_to_int(c) -> Column:
    """A value smaller than the one behind it is taken away (STR-08)."""
    known = F.create_map(*(F.lit(x) for pair in _NUMERALS.items() for x in pair))
    chars = F.split(F.reverse(F.upper(_col(c))), "")
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).otherwise(0)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda a, x: F.struct((a["sum"] + F.when(value(x) < a["last"], -value(x)).otherwise(value(x))).alias("sum"), value(x).alias("last"))
    return F.coalesce(F.try_element_at(known, F.upper(_col(c))), F.aggregate(chars, start, step, lambda a: a["sum"]))


def smart_title(c) -> Column:
    """Title case for text all in capitals; small words stay small unless first (STR-09)."""
    word = lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    titled = lambda x: F.array_join(F.transform(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), word), " ")
    told = lambda x: F.when((x == F.upper(x)) & (x != F.lower(x)), titled(x)).otherwise(x)
    return told(F.col(c)) if isinstance(c, str) else once(c, told)


def bare_title_en(c) -> Column:
    """A title without white space around it and trailing marks."""
    return strip(F.regexp_replace(strip(c), r"[:. ]+$", ""))


def clean_title_en(c) -> Column:
    return smart_title(bare_title_en(c))


def clean_title_ar(c) -> Column:
    """No round brackets around it, no trailing marks, null when nothing is left (STR-10)."""
    x = F.regexp_replace(strip(F.regexp_replace(strip(c), r"^[()]+|[()]+$", "")), r"[:.]+$", "")
    return F.nullif(strip(x), F.lit(""))


#: Marker lines of both languages, alone or with text behind them on the same line.
MARKERS = [r"^A?rticle\s*([0-9]+)$", r"^مادة\s*[()]?\s*([0-9٠-٩]+)\s*[()]?$"]
GLUED_MARKERS = [r"^A?rticle\s*([0-9]+)\s+(?=[A-Z(])(.+)$", r"^مادة\s*[()]?\s*([0-9٠-٩]+)\s*[()]?\s+(.+)$"]


def marker(c) -> Column:
    """(number, rest) of a line that is a marker of either language, ``rest`` the text that is glued to it or
    null; null for any other line (STR-13)."""
    c = _col(c)
    found = F.lit(None).cast("struct<number: int, rest: string>")
    for pattern in reversed(GLUED_MARKERS):
        found = F.when(c.rlike(pattern), F.struct(fold_digits(F.regexp_extract(c, pattern, 1)).try_cast("int").alias("number"), F.regexp_extract(c, pattern, 2).alias("rest"))).otherwise(found)
    for pattern in reversed(MARKERS):
        found = F.when(c.rlike(pattern), F.struct(fold_digits(F.regexp_extract(c, pattern, 1)).try_cast("int").alias("number"), F.lit(None).cast("string").alias("rest"))).otherwise(found)
    return found


def marker_number(c) -> Column:
    """The number of a marker line of either language, else null (STR-13)."""
    return marker(c)["number"]


def repeal_range(c) -> Column:
    """(first, last) of a repeal note, else null (STR-14)."""
    pattern = r"(?i)Articles?\s+(\d+)\s*(?:-|–|to)\s*(\d+).*repealed"
    a, b = (F.regexp_extract(_col(c), pattern, i).try_cast("int") for i in (1, 2))
    # a cast that fails costs an exception, so that other lines are not cast
    return F.when(_col(c).rlike(pattern), F.when(a.isNotNull(), F.struct(a.alias("first"), b.alias("last"))))


#: How questions name articles, and how answers cite them.
NAMED_EN = r"(?i)\barticles?\s+([0-9]{1,4})\b"
NAMED_AR = r"(?:المادة|مادة|المواد)\s*(?:رقم\s*)?[(]?\s*([0-9٠-٩]{1,4})"
CITED = r"(?i)[\[【［]\s*Art(?:icle)?s?\.?\s*([0-9٠-٩]+)\s*[\]】］]"


def numbers_in_question(c, first: int, last: int) -> Column:
    """Numbers named in a question, English mentions before Arabic ones, first seen first (STR-15)."""
    found = F.concat(*(F.regexp_extract_all(_col(c), F.lit(p), F.lit(1)) for p in (NAMED_EN, NAMED_AR)))
    numbers = F.transform(found, lambda x: fold_digits(x).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.between(first, last)))


def extract_citations(c) -> Column:
    """Distinct cited numbers in the order of the text (STR-16)."""
    found = F.regexp_extract_all(_col(c), F.lit(CITED), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: fold_digits(x).try_cast("int")))


def arabic_share(c) -> Column:
    letters = F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(F.regexp_replace(_col(c), r"[^\p{L}]", ""), r"[^\x{0600}-\x{06FF}]", ""))
    return F.when(letters == 0, 0.0).otherwise(arabic / letters)


def question_language(c) -> Column:
    """``ar`` when half of the letters or more are Arabic (STR-17)."""
    return F.when(arabic_share(c) >= 0.5, "ar").otherwise("en")


def heading_path(levels: list[tuple[str, Column, Column]]) -> Column:
    """(label, number, title) from high to low, joined; levels without a title are left out (STR-18)."""
    parts = [F.when(_col(t).isNotNull(), F.concat_ws(" ", F.lit(label) if label else None, _col(n).cast("string"), _col(t)) if label else _col(t)) for label, n, t in levels]
    return F.concat_ws(" > ", *parts)


def record_path() -> Column:
    """The bilingual path of a record (STR-18): ``Section 2 Persons | الفصل الثاني الأشخاص > ...``. Numbers up to ten
    are spelled in Arabic, topics have no Arabic label; a level without number and English title is left out."""
    spelled = F.create_map(*(F.lit(x) for i, w in enumerate(ORDINALS_AR, 1) for x in (i, w)))
    filled = lambda x: F.nullif(_col(x), F.lit(""))
    parts = []
    for level, (en, ar) in LEVEL_NAMES.items():
        n, title_en, title_ar = F.col(f"{level}_number"), filled(f"{level}_title_en"), filled(f"{level}_title_ar")
        left = F.when(n.isNotNull(), F.concat_ws(" ", F.lit(en), n.cast("string"), title_en)).otherwise(title_en)
        right = title_ar if ar is None else F.when(n.isNotNull(), F.concat_ws(" ", F.lit(ar), F.coalesce(F.try_element_at(spelled, n.cast("int")), n.cast("string")), title_ar)).otherwise(title_ar)
        parts.append(F.when(left.isNotNull(), F.concat_ws(" | ", left, right)))
    sub = filled("subtopic_title_en")
    parts.append(F.when(sub.isNotNull(), F.concat_ws(" | ", sub, filled("subtopic_title_ar"))))
    return F.concat_ws(" > ", *parts)


def record_header() -> Column:
    """The path and the label line of a record (STR-19)."""
    n = F.col("article_number").cast("string")
    label = F.concat(F.lit("Article "), n, F.lit(" | مادة "), n, F.when(F.col("is_repealed"), " (repealed | ملغاة)").otherwise(""))
    return lines(record_path(), label)


def record_body(lang: str | None = None) -> Column:
    """The text of a record, or its repeal note, in one language or both (STR-19, STR-27)."""
    side = {"ar": F.when(F.col("is_repealed"), F.col("repeal_note_ar")).otherwise(F.col("text_ar")), "en": F.when(F.col("is_repealed"), F.col("repeal_note")).otherwise(F.col("text_en"))}
    return lines(*([side[lang]] if lang else [side["ar"], side["en"]]))


def question_message(question, context) -> Column:
    """What a model is asked: the articles, the question, and the language to answer in (STR-26)."""
    say = F.when(question_language(question) == "ar", ANSWER_IN["ar"]).otherwise(ANSWER_IN["en"])
    return F.concat(F.lit("<articles>\n"), _col(context), F.lit("\n</articles>\n\n<question>\n"), _col(question), F.lit("\n</question>\n\n"), say)


def run_name(strategy, model, size, overlap) -> Column:
    """The name of a grid run (STR-22): windows carry their size and overlap."""
    window = F.concat(F.lit("-"), _col(size).cast("string"), F.lit("o"), F.coalesce(_col(overlap), F.lit(0)).cast("string"))
    return F.concat(_col(strategy), F.when(_col(strategy) == "window", window).otherwise(""), F.lit("__"), F.element_at(F.split(_col(model), "/"), -1))


def stamped_name(ts) -> Column:
    """``20240131-0859`` in UTC of a timestamp, whatever the session's time zone (DAT-01)."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(_col(ts).cast("timestamp")).cast("decimal(18,6)"))
    return F.regexp_replace(at.cast("string"), r"^(\d+)-(\d+)-(\d+) (\d+):(\d+).*$", "$1$2$3-$4$5")


def topic_group(c) -> Column:
    """What stands before the colon (MIS-15)."""
    return strip(F.split_part(_col(c), F.lit(":"), F.lit(1)))


def present(entries) -> Column:
    """A map without its null values (MAP-02)."""
    return F.map_filter(_col(entries), lambda k, v: v.isNotNull())


def overridden(a, b) -> Column:
    """A map with the entries of another one, which win (MAP-01)."""
    return F.map_concat(F.map_filter(_col(a), lambda k, v: ~F.map_contains_key(_col(b), k)), _col(b))


def under_prefix(entries, prefix: str) -> Column:
    """The entries whose key begins with a prefix, without it (MAP-03)."""
    own = F.map_filter(_col(entries), lambda k, v: k.startswith(prefix))
    return F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def megabytes(size) -> Column:
    return F.round(_col(size) / (1024.0 * 1024.0), 1)


def milliseconds(seconds) -> Column:
    return F.round(_col(seconds) * 1000.0, 1)


def lines(*parts) -> Column:
    """Non-empty parts, a line each (STR-19, STR-27)."""
    return F.concat_ws("\n", *(F.nullif(_col(p), F.lit("")) for p in parts))


def slug(c, longest: int = 120) -> Column:
    """A collection name (STR-20)."""
    x = F.regexp_replace(F.lower(F.element_at(F.split(_col(c), "/"), -1)), r"[^a-z0-9._-]", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"^[-._]+", ""), r"[-._]+$", ""), 1, longest)


def chunk_id(number, suffix=None) -> Column:
    """``art-0044`` with a suffix (STR-21)."""
    return F.concat_ws("-", F.format_string("art-%04d", _col(number)), *([] if suffix is None else [suffix]))


def display_topic(section, detail, fallback) -> Column:
    """``Section: detail`` with fallbacks (STR-28)."""
    return F.coalesce(F.nullif(F.concat_ws(": ", F.nullif(_col(section), F.lit("")), F.nullif(_col(detail), F.lit(""))), F.lit("")), _col(fallback))


def markdown_cell(c) -> Column:
    """Text that stays in its cell of a table (STR-29)."""
    return F.replace(F.replace(_col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def tail(c, n: int = 40) -> Column:
    """The end of a long text (STR-24)."""
    return F.when(F.length(_col(c)) > n, F.concat(F.lit("…"), F.right(_col(c), F.lit(n)))).otherwise(_col(c))


def squash(c) -> Column:
    """Without any white space (STR-25)."""
    return F.regexp_replace(_col(c), r"\s+", "")


def json_inside(c) -> Column:
    """The object from the first to the last brace, null when there is none (STR-32)."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))


def tokens(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"\S+"), F.lit(0))


def expand_ranges(c) -> Column:
    """``["54-80", "90"]`` to numbers (ARR-02)."""
    return F.flatten(F.transform(_col(c), lambda x: F.sequence(F.split_part(x, F.lit("-"), F.lit(1)).cast("int"), F.split_part(F.concat(x, F.lit("-"), x), F.lit("-"), F.lit(2)).cast("int"))))


def in_sequence(c) -> Column:
    """Whether values are 1, 2, ... n (ARR-03); an empty list is."""
    return F.when(F.size(_col(c)) == 0, True).otherwise(_col(c) == F.sequence(F.lit(1), F.size(_col(c))))


def citation_check(cited, retrieved) -> Column:
    """(valid, invalid) citations, in cited order (ARR-01)."""
    return F.struct(F.filter(_col(cited), lambda x: F.array_contains(_col(retrieved), x)).alias("valid"), F.filter(_col(cited), lambda x: ~F.array_contains(_col(retrieved), x)).alias("invalid"))


def first_rank(ranked, relevant) -> Column:
    """The best place of a relevant item, null for a miss (ARR-04)."""
    return F.array_min(F.filter(F.transform(_col(ranked), lambda x, i: F.when(F.array_contains(_col(relevant), x), i + 1)), lambda x: x.isNotNull()))


def force_positive(candidates, positive, k: int) -> Column:
    """The positive is among k candidates, at the end if it was missing (ARR-05)."""
    c = _col(candidates)
    return F.when(F.array_contains(c, _col(positive)), c).otherwise(F.concat(F.slice(c, 1, k - 1), F.array(_col(positive))))


#: Words that name heading levels and ordinals.
PART_ORDINALS = {"FIRST": 1, "SECOND": 2, "THIRD": 3, "FOURTH": 4}
ORDINAL_PREFIXES = {"أولا": 1, "ثانيا": 2, "ثالثا": 3, "رابعا": 4, "خامسا": 5, "سادسا": 6}
DIACRITICS = r"[\x{064B}-\x{0652}\x{0670}]"


#: What any English heading keyword begins with, so that other lines are looked at once.
_OPENS = rf"(?i)^(?:{'|'.join(PART_ORDINALS)}|BOOK|CHAPTER|SECTION)\b"


def heading_keyword(c) -> Column:
    """(level, number, rest) of a line that opens a part, book, chapter or section, else null (STR-12)."""
    part = rf"(?i)^({'|'.join(PART_ORDINALS)})\s+PART\b\.?\s*(.*)$"

    def told(c: Column) -> Column:
        ordinal = F.element_at(F.create_map(*(F.lit(x) for pair in PART_ORDINALS.items() for x in pair)), F.upper(F.regexp_extract(c, part, 1)))
        found = F.when(c.rlike(part), F.struct(F.lit("part").alias("level"), ordinal.alias("number"), F.regexp_extract(c, part, 2).alias("rest")))
        keyword = r"(?i)^(BOOK|CHAPTER|SECTION)\s+([IVXL]+)\b\.?\s*(.*)$"
        number = roman_to_int(F.regexp_extract(c, keyword, 2)).cast("int")
        found = found.when(c.rlike(keyword), F.struct(F.lower(F.regexp_extract(c, keyword, 1)).alias("level"), number.alias("number"), F.regexp_extract(c, keyword, 3).alias("rest")))
        return found

    return F.when(_col(c).rlike(_OPENS), once(c, told))


def ar_number(c) -> Column:
    """(number, title) of an Arabic heading that a number or an ordinal word opens; number null where neither
    does (STR-11). Diacritics do not count."""
    digits, words = r"^([٠-٩0-9]+)\s*[-–.]\s*(.+)$", rf"^({'|'.join(ORDINAL_PREFIXES)})\s*[:：]?\s*-?\s*(.+)$"
    made = lambda number, title: F.struct(number.cast("int").alias("number"), title.alias("title"))

    def told(plain: Column) -> Column:
        ordinal = F.element_at(F.create_map(*(F.lit(x) for pair in ORDINAL_PREFIXES.items() for x in pair)), F.regexp_extract(plain, words, 1))
        return F.when(plain.rlike(digits), made(fold_digits(F.regexp_extract(plain, digits, 1)), F.regexp_extract(plain, digits, 2))).when(plain.rlike(words), made(ordinal, F.regexp_extract(plain, words, 2))).otherwise(made(F.lit(None), plain))

    return once(F.regexp_replace(_col(c), DIACRITICS, ""), told)
