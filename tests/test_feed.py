"""The page feed against a walk over the lines, one after another."""

import random
import re

import pytest

from corpusframe.operators import feed

LINE = "doc string, page int, lang string, at int, text string, bold boolean, row int, y0 double"
EN = re.compile(r"^A?rticle\s*([0-9]+)(?:\s+(?=[A-Z(])(.+))?$")
AR = re.compile(r"^مادة\s*[()]?\s*([0-9٠-٩]+)\s*[()]?(?:\s+(.+))?$")
NOTE = re.compile(r"(?i)Articles?\s+(\d+)\s*(?:-|–|to)\s*(\d+).*repealed")


class Walk:
    """The rules of the feed for one document, line by line."""

    def __init__(self, repealed=()):
        self.last, self.gone, self.issues, self.text, self.seen, self.marker = {"en": 0, "ar": 0}, {n for a, b in repealed for n in range(a, b + 1)}, [], {}, set(), {}
        self.heads, self.notes, self.blocks, self.head_of = [], [], [], {}

    def say(self, page, lang, code, level="info", number=None):
        self.issues.append((page, lang, level, code, number))

    def starts(self, lines):
        plain, out = set(), []
        for x in lines:
            out.append(x["row"] is None or x["row"] not in plain)
            if not x["bold"]:
                plain.add(x["row"])
        return out

    def verdict(self, lang, n, start, top):
        """(accepted, code)"""
        missing = set(range(self.last[lang] + 1, n)) - self.gone
        if n <= self.last[lang]:
            return False, "CROSS_REFERENCE_SKIPPED" if start else None
        if start and missing:
            return (False, "AMBIGUOUS_MARKER") if lang == "en" and top else (True, "GAP_BEFORE_ARTICLE")
        if start:
            return True, None
        return (False, "MARKER_MID_ROW_IGNORED") if lang == "en" else (not missing, None if missing else "MARKER_MID_ROW")

    def try_marker(self, lang, x, start, top):
        m = (EN if lang == "en" else AR).match(x["text"])
        if not m:
            return False
        n = int(m[1])
        ok, code = self.verdict(lang, n, start, top)
        if code:
            loud = code in ("AMBIGUOUS_MARKER", "GAP_BEFORE_ARTICLE")
            self.say(x["page"], lang, code, "warning" if loud else "info", n if ok else self.last[lang] or None)
        if ok:
            self.last[lang] = n
            if lang == "en" and not x["text"].startswith("Article "):
                self.say(x["page"], lang, "MARKER_TYPO", number=n)
            self.text[lang, n] = [(x["page"], m[2])] if m[2] else []
            self.marker[lang, n] = (x["page"], x["row"])
            if m[2]:
                self.say(x["page"], lang, "MARKER_GLUED", number=n)
            self.head_of[lang, n] = self.head_of[("en", n)] if lang == "ar" and ("en", n) in self.head_of else len(self.heads)
        return ok

    def beside(self, page, block, note, used):
        row, low, high = block[0]["row"], block[0]["y0"] - 4, block[-1]["y0"] + 4
        stops = [a["y0"] for a in page if row is not None and a["row"] == row and AR.match(a["text"])]
        out = []
        for j, a in enumerate(page):
            above = row is not None and a["row"] == row and a["y0"] < min(stops, default=1e9)
            if j not in used and not AR.match(a["text"]) and (above or a["row"] is None and (a["bold"] or note) and low <= a["y0"] <= high):
                used.add(j)
                out.append(a["text"])
        return out

    def page(self, en, ar):
        used, i, start = set(), 0, self.starts(en)
        while i < len(en):
            x, j = en[i], i + 1
            if x["row"] is not None:
                self.seen.add("en")
            if "en" not in self.seen:
                self.say(x["page"], "en", "PREAMBLE")
            elif self.try_marker("en", x, start[i], i == 0):
                pass
            elif NOTE.search(x["text"]):
                while j < len(en) and en[j]["row"] == x["row"] and not EN.match(en[j]["text"]):
                    j += 1
                whole = " ".join(y["text"] for y in en[i:j])
                m = NOTE.search(whole)
                self.gone |= set(range(int(m[1]), int(m[2]) + 1))
                self.say(x["page"], "en", "REPEAL_NOTE")
                self.notes.append((int(m[1]), int(m[2]), whole.lstrip("* ").strip(), " ".join(self.beside(ar, en[i:j], True, used)).lstrip("* ").strip()))
            elif x["bold"] and start[i]:
                while j < len(en) and en[j]["bold"] and en[j]["row"] == x["row"] and not EN.match(en[j]["text"]) and not NOTE.search(en[j]["text"]):
                    j += 1
                self.heads.append(i)
                self.blocks.append((x["page"], [y["text"] for y in en[i:j]], self.beside(ar, en[i:j], False, used)))
            else:
                self.body("en", x, start[i] and i > 0)
            i = j
        start = self.starts(ar)
        for j, x in enumerate(ar):
            if j in used:
                continue
            if x["row"] is not None:
                self.seen.add("ar")
            if "ar" not in self.seen:
                self.say(x["page"], "ar", "PREAMBLE")
            elif not self.try_marker("ar", x, start[j], j == 0):
                if x["bold"] and start[j]:
                    self.say(x["page"], "ar", "AR_HEADING_UNPAIRED")
                else:
                    self.body("ar", x, False)

    def body(self, lang, x, opens):
        n = self.last[lang]
        if not n:
            self.say(x["page"], lang, "TEXT_BEFORE_FIRST_ARTICLE", "info" if x["row"] is None else "warning")
            return
        if lang == "en" and opens and x["row"] is not None and self.marker["en", n] != (x["page"], x["row"]):
            self.say(x["page"], lang, "ROW_WITHOUT_MARKER", number=n)
        self.text[lang, n].append((x["page"], x["text"]))

    def end(self):
        for lang, n in sorted(self.marker):
            if lang == "en" and ("ar", n) in self.marker and self.marker["ar", n] != self.marker["en", n]:
                outside = None in (self.marker["ar", n][1], self.marker["en", n][1])
                self.say(self.marker["en", n][0], "en", "ROW_MISMATCH", "info" if outside else "warning", n)
        for n in {n for _, n in self.marker}:
            pages = sorted({p for lang in ("en", "ar") if (lang, n) in self.marker for p in [self.marker[lang, n][0], *(p for p, _ in self.text[lang, n])]})
            for p in pages[1:]:
                self.say(p, None, "PAGE_BREAK", number=n)
        return self


def some_pages(seed):
    """Two documents of pages with markers in and out of place, notes, headings and plain lines."""
    pick, rows = random.Random(seed), []
    for doc in ("a", "b"):
        n = {"en": 1, "ar": 1}
        for page in range(1, 7):
            for lang in ("en", "ar"):
                row = None if page == 1 else pick.choice([None, 0])
                for at in range(pick.choice([0, 5, 14])):
                    if pick.random() < 0.35:
                        row = pick.choice([None, (row or 0) + 1])
                    kind = pick.random()
                    if kind < 0.3:
                        k = n[lang] + pick.choice([0, 0, 0, 0, -1, 2])
                        n[lang] = max(n[lang], k + 1)
                        glue = pick.choice(["", "", " The law"]) if lang == "en" else pick.choice(["", " النص"])
                        text = f"{pick.choice(['Article', 'Article', 'rticle'])} {max(k, 0)}{glue}" if lang == "en" else f"مادة ({max(k, 0)}){glue}"
                    elif kind < 0.38 and lang == "en":
                        a = n["en"] + pick.choice([0, 1])
                        text = f"* Articles {a}-{a + 2} have been repealed by law"
                        n["en"], n["ar"] = a + 3, max(n["ar"], a + pick.choice([0, 3]))
                    else:
                        text = f"{pick.choice(['text', 'Chapter', 'نص'])} {pick.randint(0, 99)}"
                    rows.append((doc, page, lang, at, text, pick.random() < 0.4, row, float(10 * at + pick.randint(0, 6))))
    return rows


def walked(rows, repealed=()):
    out = {}
    for doc in sorted({r[0] for r in rows}):
        w = Walk(repealed)
        for page in sorted({r[1] for r in rows if r[0] == doc}):
            side = lambda lang, page=page, doc=doc: [dict(zip("doc page lang at text bold row y0".split(), r, strict=True)) for r in sorted(rows, key=lambda r: r[3]) if r[:3] == (doc, page, lang)]
            w.page(side("en"), side("ar"))
        out[doc] = w.end()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_feed_equals_a_walk(spark, seed):
    rows = some_pages(seed)
    repealed = [(4, 5)] if seed % 2 else []
    got = feed.fed(spark.createDataFrame(rows, LINE).repartition(3), repealed=repealed)
    want = walked(rows, repealed)
    issues = sorted((r.doc, r.page, str(r.lang), r.level, r.code, str(r.number)) for r in got.issues.collect())
    assert issues == sorted((d, p, str(lang), level, code, str(n)) for d, w in want.items() for p, lang, level, code, n in w.issues)
    texts = sorted((r.doc, r.lang, r.number, r.text) for r in feed.drafts(got).collect())
    assert texts == sorted((d, lang, n, "\n".join(t for _, t in lines)) for d, w in want.items() for (lang, n), lines in w.text.items())
    notes = sorted((r.doc, r.first, r.last, r.text_en, r.text_ar) for r in got.notes.collect())
    assert notes == sorted((d, *n) for d, w in want.items() for n in w.notes)
    blocks = sorted((r.doc, r.page, r.en, r.ar) for r in got.blocks.where("kind = 'heading'").collect())
    assert blocks == sorted((d, *b) for d, w in want.items() for b in w.blocks)
    # the heading block in force at each marker, by its place among the document's blocks
    order = {}
    for r in got.blocks.where("kind = 'heading'").orderBy("doc", "block").collect():
        order[r.doc, r.block] = 1 + sum(k[0] == r.doc for k in order)
    force = sorted((r.doc, r.lang, r.number, order.get((r.doc, r.block), 0)) for r in got.articles.collect())
    assert force == sorted((d, lang, n, k) for d, w in want.items() for (lang, n), k in w.head_of.items())


def test_hierarchy_is_carried_into_articles(spark):
    rows = [("d", 1, "en", 0, "Law", False, None, 0.0), ("d", 1, "en", 1, "First Part. General", True, 0, 10.0), ("d", 1, "en", 2, "Article 1", True, 1, 20.0), ("d", 1, "en", 3, "Text.", False, 1, 30.0), ("d", 2, "en", 0, "Chapter II. Sale", True, 0, 10.0), ("d", 2, "en", 1, "Article 2", True, 1, 20.0)]
    rows += [("d", 1, "ar", 0, "القسم الأول: عام", True, 0, 10.0), ("d", 1, "ar", 1, "مادة (١)", True, 1, 20.0), ("d", 2, "ar", 0, "مادة (٢)", True, 1, 20.0)]
    got = feed.with_hierarchy(feed.fed(spark.createDataFrame(rows, LINE)))
    at = {(r.lang, r.number): (r.part_number, r.chapter_number, r.chapter_title_en) for r in got.collect()}
    assert at == {("en", 1): (1, None, None), ("ar", 1): (1, None, None), ("en", 2): (1, 2, "Sale"), ("ar", 2): (1, 2, "Sale")}


def test_odd_lines(spark):
    rows = [("d", 1, "en", 0, None, None, 0, 1.0), (None, 1, "en", 0, "Article 1", True, 0, 1.0), ("e", 1, "ar", 0, "نص", True, None, 1.0), ("d", 1, "en", 0, None, None, 0, 1.0)]
    got = feed.fed(spark.createDataFrame(rows, LINE))
    assert sorted(r.code for r in got.issues.collect()) == ["PREAMBLE", "TEXT_BEFORE_FIRST_ARTICLE", "TEXT_BEFORE_FIRST_ARTICLE"]
    assert not feed.fed(spark.createDataFrame([], LINE)).issues.count()


def test_boxed_lines(spark):
    glyphs = [(1, 0, 0, "A", True, 10.0, 5.0, 14.0, 9.0), (1, 0, 1, " ", False, 14.0, 1.0, 99.0, 9.0), (1, 0, 2, "b", True, 16.0, 4.0, 20.0, 9.0), (1, 0, 3, ".", False, 8.0, 6.0, 9.0, 9.0), (1, 1, 4, " ", True, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(glyphs, "page int, line int, k int, c string, bold boolean, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in feed.boxed_lines(df).collect()] == [(1, 0, ".A b", True, 8.0, 20.0, 4.0)]


def test_hierarchy_deals_a_document_out_once(spark):
    """Subtopics, corrections and states follow within a document's rows: they are not dealt out, joined or united again."""
    from corpusframe.operators import hierarchy as hi

    blocks = spark.createDataFrame([("d", 1, ["BOOK III One"], ["الكتاب الثالث أول"]), ("d", 2, ["a Title", "2. Two", "Three"], ["عنوان", "٢- اثنان", "ثلاثة"])], "doc string, block long, en array<string>, ar array<string>")
    made = hi.hierarchy(blocks, [{"number": 1, "starts_at_book": 3, "title_en": "Part One", "title_ar": "قسم"}])
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan
    rows = {r.block: r for r in made.collect()}
    assert (rows[1].part_number, rows[1].book_number, rows[2].topic_number, rows[2].topic_title_en) == (1, 3, 2, "Two")
    assert rows[2].subtopic_title_en == "a Title — Three" and rows[2].subtopic_title_ar == "عنوان — ثلاثة"


def test_feed_issues_move_no_texts(spark):
    """Texts stay aside once markers and notes are found: what follows for the issues is joined and shuffled without them."""
    rows = [("d", 1, lang, at, t, False, 0, 10.0 * at) for lang, ts in (("en", ["Article 1 The sale", "one"]), ("ar", ["مادة (1)", "نص"])) for at, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "doc string, page int, lang string, at int, text string, bold boolean, row int, y0 double")
    made = feed.fed(lines)
    plan = made.issues._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "rest#" not in plan
    assert ("en", "MARKER_GLUED") in {(r.lang, r.code) for r in made.issues.collect()}
    assert {(r.lang, r.text) for r in made.lines.where("text IS NOT NULL").collect()} == {("en", "The sale"), ("en", "one"), ("ar", "نص")}
