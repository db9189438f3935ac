"""Tables inside text, and blocks of positioned spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

PIPE_TABLE = r"(?m)((?:^[ \t]*\|[^\n]*\|[ \t]*(?:\n|\z)){2,})"
HTML_TABLE = r"(?s)<table>.*?</table>"


def pipe_tables(pages: DataFrame, text: str = "text") -> DataFrame:
    """Tables of two or more neighbouring lines in pipes: (page columns, table_index, rows, row_count, col_count); separator lines are skipped."""
    keep = [c for c in pages.columns if c != text]
    each = pages.select(*keep, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(PIPE_TABLE), F.lit(1))).alias("table_index", "_t")).where("_t is not null")
    lines = F.filter(F.transform(F.split("_t", "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), strip))
    return _counted(each.select(*keep, "table_index", cells.alias("rows")))


def html_tables(pages: DataFrame, text: str = "text") -> DataFrame:
    """The same for <table> elements with <tr> rows of <td> and <th> cells."""
    keep = [c for c in pages.columns if c != text]
    each = pages.select(*keep, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(HTML_TABLE), F.lit(0))).alias("table_index", "_t")).where("_t is not null")
    rows = F.regexp_extract_all(F.col("_t"), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip))
    return _counted(each.select(*keep, "table_index", cells.alias("rows")))


def _counted(d: DataFrame) -> DataFrame:
    return d.where(F.size("rows") > 0).withColumn("row_count", F.size("rows")).withColumn("col_count", F.array_max(F.transform("rows", lambda r: F.size(r))))


def without_tables(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, HTML_TABLE, "[TABLE]"), PIPE_TABLE, "[TABLE]\n")


def normalised_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))


def own_block(spans: Column) -> list[Column]:
    """What `blocks` says of a block whose spans (text, size, font, bold) lie in order in one row, so that no row moves: text, font_size, font, bold."""
    known = lambda name: F.array_compact(spans[name])
    size = let(known("size"), lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double")), F.size(x)))
    others = lambda x: F.transform(F.array_distinct(x), lambda f: F.struct(F.size(F.array_remove(x, f)).alias("others"), f.alias("font")))
    bold = F.try_divide(F.size(F.array_remove(known("bold"), F.lit(False))), F.size(known("bold"))) > 0.5
    return [F.array_join(spans["text"], "\n").alias("text"), size.alias("font_size"), F.array_min(let(known("font"), others))["font"].alias("font"), bold.alias("bold")]


def blocks(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, span, text, size, font, bold) as blocks: text in order by lines, mean size, modal font, bold if most spans are."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "\n")
    d = spans.groupBy(*keys).agg(text.alias("text"), F.avg("size").alias("font_size"), F.mode("font", True).alias("font"), (F.avg(F.col("bold").cast("int")) > 0.5).alias("bold"))
    return d.where(strip(F.col("text")) != "")
