"""Validation of what comes in: records, requests, generated questions, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx


def record_problems(records: DataFrame, required: list[str], key: str = "article_number") -> DataFrame:
    """Records with what makes them unusable (FLT-07): ``problems`` array, empty for a good one. A required column
    that the table lacks is missing from every record; a number comes as text, so that one that is none shows."""
    lacking = [c for c in required if c not in records.columns]
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == "" if c in records.columns else F.lit(True)
    if lacking:
        return records.withColumn("problems", F.array(F.lit("missing " + ", ".join(lacking))))
    repealed = F.coalesce("is_repealed", F.lit(False))
    no_text = F.when(repealed, empty("repeal_note_ar") & empty("repeal_note")).otherwise(empty("text_ar") & empty("text_en"))
    absent = [F.when(F.col(c).isNull(), F.concat(F.lit("missing "), F.lit(c))) for c in required]
    wrong = F.when(F.col(key).isNotNull() & F.col(key).try_cast("int").isNull(), "number is no integer")
    return records.withColumn("problems", F.array_compact(F.array(*absent, wrong, F.when(no_text, "no text"))))


def question_problem(c, most: int = 2000, **space: str) -> Column:
    """Why a question is refused, null for a good one (FLT-11): its trimmed length is 1 to ``most``; ``space`` is what is
    trimmed, as in :func:`corpusframe.functions.text.strip`."""
    n = F.length(tx.strip(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), **space))
    return F.when(n == 0, "empty").when(n > most, "too long")


def unknown_ids(asked: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """The ids asked for that no record has (FLT-12); a request is good when there is none."""
    return asked.select(on).distinct().join(known.select(on).distinct(), on, "left_anti")


def usable_questions(rows: DataFrame, number: str = "n", ar: str = "ar", en: str = "en") -> DataFrame:
    """Generated questions that may be used (FLT-05): Arabic in the Arabic one and none in the English one, 10 to 300
    characters each, and neither gives the number away."""
    a, e = tx.strip(F.coalesce(F.col(ar), F.lit(""))), tx.strip(F.coalesce(F.col(en), F.lit("")))
    arabic = r"[\x{0600}-\x{06FF}]"
    told = F.contains(F.concat(a, e), F.col(number).cast("string"))
    return rows.where(a.rlike(arabic) & ~e.rlike(arabic) & F.length(a).between(10, 300) & F.length(e).between(10, 300) & ~told)


def rated(log: DataFrame, rating: str, wanted: str = "all") -> DataFrame:
    """Feedback of one rating, or all of it (FLT-10)."""
    return log if wanted == "all" else log.where(F.col(rating) == wanted)


#: Events of an answer in their order; ``delta`` may come again, and an error may end it at any place.
STEPS = {"retrieved": 0, "start": 1, "delta": 2, "done": 3}


def protocol_breaks(events: DataFrame, request: str, seq: str, kind: str) -> DataFrame:
    """(request, seq, code) where an answer's events leave their order (STM-02): OUT_OF_ORDER, AFTER_END, and NO_END
    at the last event of an answer that neither ends nor fails."""
    by = W.partitionBy(request).orderBy(seq)
    step = F.try_element_at(F.create_map(*(F.lit(x) for p in STEPS.items() for x in p)), F.col(kind))
    e = events.withColumn("_step", step).withColumn("_before", F.lag(kind).over(by)).withColumn("_last", F.lag("_step").over(by)).withColumn("_next", F.lead(kind).over(by))
    ended = F.col("_before").isin("done", "error")
    follows = (F.col(kind) == "error") | (F.col("_step") == F.coalesce(F.col("_last"), F.lit(-1)) + 1) | ((F.col(kind) == "delta") & (F.col("_before") == "delta")) | ((F.col(kind) == "done") & (F.col("_before") == "start"))
    codes = F.array_compact(F.array(F.when(F.coalesce(ended, F.lit(False)), "AFTER_END").when(~F.coalesce(follows, F.lit(False)), "OUT_OF_ORDER"), F.when(F.col("_next").isNull() & ~F.col(kind).isin("done", "error"), "NO_END")))
    return e.select(request, seq, F.explode(codes).alias("code"))
