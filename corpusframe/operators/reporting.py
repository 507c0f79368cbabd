"""Reports of runs as one document: small aggregates become lines of Markdown, in Spark, and one JSON object (SNK-07, SNK-09,
FN-13, API-04, API-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from .records import cardinalities, corpus_counts


def shown(value: str | Column, digits: int = 4) -> Column:
    """A number as reports show it, a dash for none (FN-13)."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(number.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", number))


def best(column: str) -> Column:
    """A value shown, bold where no other run's is larger (AGG-12)."""
    text = shown(column)
    return F.when(F.col(column) == F.max(column).over(W.partitionBy()), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def table(rows: DataFrame, heads: list[str], cells: list[Column], order: list[Column]) -> DataFrame:
    """(at, line): a Markdown table of a small result, a run a row; cells that hold bars or line breaks are escaped."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*(tx.markdown_cell(c) for c in cells)), " | "), F.lit(" |"))
    body = rows.select((F.row_number().over(W.orderBy(*order)) + 1).alias("at"), line.alias("line"))  # a report's rows
    head = [(0, "| " + " | ".join(heads) + " |"), (1, "|" + "---|" * len(heads))]
    return rows.sparkSession.createDataFrame(head, "at int, line string").unionByName(body)


def lines(spark: SparkSession, *text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text)), "at int, line string")


def document(*parts: DataFrame) -> DataFrame:
    """(part, at, line): the parts of a report one after another, a blank line behind each."""
    out = None
    for i, p in enumerate(parts):
        end = p.sparkSession.createDataFrame([(1 << 30, "")], "at int, line string")
        here = p.unionByName(end).select(F.lit(i).alias("part"), "at", "line")
        out = here if out is None else out.unionByName(here)
    return out


def write_document(report: DataFrame, path: str) -> None:
    """One text file, line after line."""
    report.orderBy("part", "at").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> str | None:
    """A written report, None where there is none (API-09)."""
    from pyspark.errors import AnalysisException

    try:
        return "\n".join(r["value"] for r in spark.read.text(path).collect())
    except AnalysisException:
        return None


def corpus_json(records: DataFrame, issues: DataFrame, levels: list[str]) -> DataFrame:
    """(report): counts, different headings of each level and issues by level and code, as one JSON object (SNK-07)."""
    count = corpus_counts(records)
    distinct = cardinalities(records, levels).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("hierarchy"))
    found = issues.groupBy("level", "code").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("level", "code", "n"))).alias("issues"))
    return count.crossJoin(distinct).crossJoin(found).select(F.to_json(F.struct(*count.columns, "hierarchy", "issues")).alias("report"))


def warnings(summary: DataFrame) -> DataFrame:
    """What a console shows of a report: warnings alone, most first (API-04)."""
    return summary.where("level = 'warning'").orderBy(F.desc("n"), "code")
