"""JSON files, one document each, read whole by Spark's own reader: rows of the good ones, an error row for each bad one.

Files come from any store that Spark reads.  A missing folder or a folder
without such files is an empty table.  Rows never depend on the order of files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import CHUNK, OBLIGATIONS, TRUTH

PAGES = "array<struct<page:int,content:string,processing_time_seconds:double,processing_time_ms:double>>"
TIMES = "total_processing_time_ms double, total_time_seconds double"


def _struct(ddl: str) -> str:
    """The DDL of columns as that of a struct."""
    return "struct<" + ", ".join(c.strip().replace(" ", ": ", 1) for c in _split(ddl)) + ">"


def _split(ddl: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]


def json_files(spark: SparkSession, path: str, schema: str, name: str | None = None, single: bool = False) -> DataFrame:
    """(path, folder, file, content_md5, value, error) of every file under `path` (globs allowed; `name`: only files so called).

    `value` is what the file holds as `schema`, null where it holds something
    else; `error` says so.  A file that is cut off or no JSON is an error, and so is a
    single object where a list is expected; with `single` such an object is a list of one.  Files of no bytes are skipped, as Spark's readers pass them over.
    """
    nothing = spark.createDataFrame([], f"path string, folder string, file string, content_md5 string, value {schema}, error string")
    reader = spark.read.format("binaryFile")
    try:
        files = (reader.option("pathGlobFilter", name) if name else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return nothing
    text = F.decode("content", "UTF-8")
    begins = r"^\s*[\[{]" if single else r"^\s*\[" if schema.startswith("array") else r"^\s*\{"
    d = files.select("path", F.md5("content").alias("content_md5"), text.alias("text"))
    d = d.withColumn("value", F.when(F.col("text").rlike(begins) & F.col("text").rlike(r"[\]}]\s*\z"), F.from_json("text", schema)))
    whole = F.coalesce(F.to_json(F.from_json("text", F.lit(schema))), F.lit("")) != ""
    parts = F.split("path", "/")
    error = F.when(F.col("value").isNull() | ~whole, F.lit(f"not {'a list' if schema.startswith('array') else 'an object'} of the expected form"))
    return d.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "content_md5", F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))


def read_chunk_files(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of all files, each with the file that it came from, and the files that hold none."""
    files = json_files(spark, path, f"array<{_struct(CHUNK)}>", name)
    return files.select(F.explode("value").alias("c"), "folder").select("c.*", "folder"), files.where("error is not null").drop("value")


def read_truth_files(spark: SparkSession, path: str, name: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Annotations as four tables by document, and the files that are none.

    A file is the annotation of one document (named as the file where it has no name), or a list of them, each with its document's name.
    """
    files = json_files(spark, path, f"array<{_struct(TRUTH)}>", name, single=True)
    own = F.coalesce("value.document_id", F.regexp_replace("file", r"\.json$", ""))
    d = files.where("error is null").select("file", F.explode("value").alias("value")).select(own.alias("document_id"), "value")
    kinds = {"articles": "articles", "tables": "tables", "cross_refs": "cross_references", "footnotes": "footnotes"}
    return {k: d.select("document_id", F.explode(f"value.{c}").alias("x")).select("document_id", "x.*") for k, c in kinds.items()}, files.where("error is not null").drop("value")


def read_obligation_files(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Obligation nodes, (article_node_id, obligation_node_id), and the files that hold neither."""
    files = json_files(spark, path, _struct(OBLIGATIONS), name)
    d = files.where("error is null").select("value.*")
    return d.select(F.explode("obligations").alias("x")).select("x.*"), d.select(F.explode("relationships").alias("x")).select("x.*"), files.where("error is not null").drop("value")


def read_page_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages (source_id, page, content, ms) and documents (source_id, total_ms, error) of folders <source_id>/pages.json.

    A page's time is in milliseconds, or a thousand times its seconds, or 0;
    that of a document is what extraction_summary.json says in either unit, or
    0 without one.  A folder whose pages can't be read has no pages and says why.
    """
    pages = json_files(spark, f"{path}/*/pages.json", PAGES)
    times = json_files(spark, f"{path}/*/extraction_summary.json", _struct(TIMES)).where("error is null")
    either = lambda ms, s: F.coalesce(F.col(ms), F.col(s) * 1000, F.lit(0.0))
    totals = times.select(F.col("folder").alias("source_id"), either("value.total_processing_time_ms", "value.total_time_seconds").alias("total_ms"))
    documents = pages.select(F.col("folder").alias("source_id"), "error").join(totals, "source_id", "left").select("source_id", F.coalesce("total_ms", F.lit(0.0)).alias("total_ms"), "error")
    rows = pages.select(F.col("folder").alias("source_id"), F.explode("value").alias("p"))
    return rows.select("source_id", "p.page", F.coalesce("p.content", F.lit("")).alias("content"), either("p.processing_time_ms", "p.processing_time_seconds").alias("ms")), documents


def write_files(df: DataFrame, path: str, value: Column, mode: str = "overwrite") -> None:
    """One file for each row: the value as JSON.  Written again, the folder holds the same files' contents and no others; with mode "append" those that it has stay."""
    rows = df.select((F.to_json(value, {"ignoreNullFields": "false"})).alias("value"))
    rows.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_results(individual: DataFrame, aggregated: DataFrame, path: str, order: list[str], rounding: dict[str, int] | None = None) -> None:
    """A folder with the two tables of a comparison, `individual` and `aggregated`, as lines of JSON, columns rounded.

    Each table is sorted by its `order` columns across its files, so that what is written depends on the rows alone.
    """
    for name, df in (("individual", individual), ("aggregated", aggregated)):
        rounded = df.withColumns({c: F.round(c, n) for c, n in (rounding or {}).items() if c in df.columns})
        by = [c for c in order if c in df.columns]
        rounded.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, individual: str, aggregated: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(individual).json(f"{path}/individual"), spark.read.schema(aggregated).json(f"{path}/aggregated")
