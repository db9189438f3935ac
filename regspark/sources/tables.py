"""Scans and sinks: chunk, ground-truth, page and obligation JSON; stored tables; keyed upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = (
    "chunk_id string, text string, source_id string, instrument_type string, jurisdiction string, chapter string, section string, article string, "
    "paragraph string, page_numbers array<int>, cross_references array<string>, has_table boolean, has_footnote boolean, chunk_index int, extractor_name string"
)
TRUTH = (
    "document_id string, articles array<struct<number:string,title:string,paragraph_count:int>>, tables array<struct<page:int,rows:int,cols:int,cells:array<array<string>>>>, "
    "cross_references array<struct<source_article:string,target_article:string,page:int>>, footnotes array<struct<page:int,marker:string,text:string>>"
)
OBLIGATIONS = (
    "obligations array<struct<node_id:string,description:string,obligation_type:string,source_id:string,article_label:string,subject:string>>, "
    "relationships array<struct<article_node_id:string,obligation_node_id:string>>"
)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or f"{tempfile.gettempdir()}/regspark").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a table of its own in the shared folder."""
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: How stored tables are compressed: texts take about two thirds of what they take with the default.
CODEC = "zstd"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the folder that all executors share, for what several later steps read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Where this session has put the tables that are made once for each version of their input.
_KEPT: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of the files under the paths; the files themselves are not read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{total}"


def stored_once(spark: SparkSession, name: str, of: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table `name` of the input version `of`: built when a session first asks for it, read from then on."""
    key = (spark.sparkContext.applicationId, name, of)
    if key not in _KEPT:
        path = new_folder(spark, name)
        df = build()
        df.write.option("compression", CODEC).parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files (JSON arrays), one per source; the order is (source_id, chunk_index), never that of files."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def read_ground_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Annotations, one file per document, as four tables; the document is the file's name if the file names none."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    d = spark.read.schema(TRUTH).option("multiLine", True).json(path).withColumn("document_id", F.coalesce("document_id", name))
    kinds = {"articles": "articles", "tables": "tables", "cross_refs": "cross_references", "footnotes": "footnotes"}
    return {k: d.select("document_id", F.explode(c).alias("x")).select("document_id", "x.*") for k, c in kinds.items()}


def read_obligations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Obligation nodes and their edges."""
    d = spark.read.schema(OBLIGATIONS).option("multiLine", True).json(path)
    return d.select(F.explode("obligations").alias("x")).select("x.*"), d.select(F.explode("relationships").alias("x")).select("x.*")


def assembled(pages: DataFrame) -> DataFrame:
    """Documents of pages (source_id, page, content, ms): texts in page order with blank lines between, counts and times."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda p: p["content"]), "\n\n")
    return pages.groupBy("source_id").agg(text.alias("full_text"), F.count(F.lit(1)).alias("pages"), F.round(F.sum("ms"), 2).alias("total_ms"))


def last_of_each(df: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row per key: the last by `order`, or the first."""
    by = F.asc(order) if first else F.desc(order)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_r = 1").drop("_r")


def upserted(target: DataFrame, batch: DataFrame, keys: list[str], order: str, insert_only: bool = False) -> DataFrame:
    """The target with a batch merged in by key: the batch wins, or, with `insert_only`, what is there stays."""
    new = last_of_each(batch, keys, order, first=insert_only)
    if insert_only:
        return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_snapshot(df: DataFrame, path: str, recreate: bool = True) -> None:
    """Replace a table, or leave one that exists alone."""
    df.write.mode("overwrite" if recreate else "ignore").parquet(path)
