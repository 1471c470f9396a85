"""Streams over files that end."""

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.streaming import ingest


def test_late_supplements(spark, tmp_path):
    t = pd.Timestamp("2026-01-01")
    rows = pd.DataFrame({"base": ["a", "a", "b"], "pdf": ["a", "a_SI", "b"], "is_supplement": [False, True, False], "ts": [t, t, t]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = ingest.drained(ingest.awaited_supplements(stream), str(tmp_path / "cp")).collect()
    assert ("a", "a", "a_SI") in {tuple(r) for r in got}


def test_cleaned_stream_is_the_cleaned_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n12\nsee 10.1103/PhysRevB.1"), (2, None)], "doc_id long, md string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), docs.schema)
    got = ingest.drained(ingest.cleaned_documents(stream), str(tmp_path / "cp")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "a\nsee 10.1103/PhysRevB.1", "10.1103/physrevb.1", "aps-prb"), (2, None, None, None)]


def test_batches_append_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.upsert_each_batch(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 5
