"""Names for display, phrases of uncertainty, queries in blocks, the shared folder, and the stream's batches."""

import pytest
from pyspark.sql import functions as F

from regspark.functions import text as tx
from regspark.operators import context as cx
from regspark.operators import search as se
from regspark.sources import tables as tb


def test_names_for_display(spark):
    d = spark.createDataFrame([("statute", "gdpr"), ("guidance", "edpb_consent"), ("commentary", "other"), ("treaty", "fadp"), (None, None)], "kind string, source string")
    got = d.select(tx.named(F.col("kind"), tx.AUTHORITIES).alias("k"), tx.named(F.upper("source"), tx.SOURCES).alias("s")).collect()
    assert [r.k for r in got] == ["Statute", "Regulator Guidance", "Commentary", "treaty", None]
    assert [r.s for r in got] == ["GDPR", "EDPB Guidelines on Consent", "OTHER", "Swiss FADP", None]
    line = d.limit(1).select(cx.benchmark_passage(F.lit("fadp"), [F.lit("Art. 1")], F.lit(2), F.lit(" text ")).alias("p")).first().p
    assert line == '[2] Source: Swiss FADP, Art. 1\n"text"'


def test_weaker_phrases_count_as_uncertainty(spark):
    d = spark.createDataFrame([("The law does not specifically say so.",), ("There is no direct rule.",), ("It applies.",), (None,)], "t string")
    assert [r.u for r in d.select(tx.says_any(F.col("t"), tx.UNCERTAINTY).alias("u")).collect()] == [True, True, False, False]
    assert not d.select(F.bool_or(tx.says_any(F.col("t"))).alias("u")).first().u


def test_queries_in_blocks_are_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vec array<double>")
    q = e.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    c = e.select(F.col("id").alias("chunk_id"), "vec")
    one = sorted(se.top_k(q, c, 3).collect())
    monkeypatch.setattr(se, "SENT", 4)
    assert sorted(se.top_k(q, c, 3).collect()) == one and len(one) == 45


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def __init__(self, **settings):
            self.settings = settings

        def get(self, name, default=None):
            return self.settings.get(name.replace(".", "_"), default)

    class Session:
        def __init__(self, **settings):
            self.conf = Conf(**settings)

    assert tb.shared_folder(Session(spark_checkpoint_dir="store://x/", spark_master="yarn")) == "store://x"
    assert tb.shared_folder(Session(spark_master="local[2]"))
    with pytest.raises(ValueError, match="checkpoint"):
        tb.shared_folder(Session(spark_master="yarn"))
