from pyspark.sql import functions as F

from sitespec.llm import id_filter as module
from sitespec.llm.id_filter import IdBits


def test_holds_all_ids_and_few_others(spark, monkeypatch):
    ids = spark.range(0, 30_000, 3).union(spark.createDataFrame([(None,), (-(2**63),)], "id long")).select(F.col("id").alias("x"))
    bits, rows = IdBits(ids), spark.range(30_000)
    assert bits.held(rows, "id").filter("id % 3 = 0").count() == 10_000
    assert bits.held(rows, "id").count() + bits.others(rows, "id").count() == 30_000
    assert bits.held(rows, "id").count() < 13_000
    odd = spark.createDataFrame([(None, "a"), (-(2**63), "b"), (-(2**63), "b")], "id long, _x string")
    assert [tuple(r) for r in bits.held(odd, "id").collect()] == [(-(2**63), "b")] * 2
    assert [tuple(r) for r in bits.others(odd, "id").collect()] == [(None, "a")]
    monkeypatch.setattr(module, "MOST_BITS", 128)  # a full set holds more, and loses none
    assert IdBits(ids).held(rows, "id").filter("id % 3 = 0").count() == 10_000
    none = IdBits(ids.limit(0))
    assert none.held(rows, "id").count() == 0 and none.others(rows, "id").count() == 30_000
