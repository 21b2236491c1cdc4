import pytest
from pyspark.sql import functions as F

from tagloom.operators import models


def test_errors_stay_with_their_item(spark):
    @models.register("length", "array<struct<tag:string,n:int>>")
    def length_model():
        return lambda values: [[{"tag": v, "n": 1000 // len(v)}] for v in values]

    items = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "abcd")], "id long, name string").coalesce(1)
    got = {r.id: r for r in models.apply(items, "length", "name").collect()}
    assert got[1].result[0].n == 500 and got[4].result[0].n == 250
    assert got[2].result is None and got[2].result_error.startswith("ZeroDivisionError") and got[3].result_error.startswith("TypeError")
    assert "length" in models.names()
    assert models.apply(items.limit(0), "length", "name").collect() == []


def test_results_are_appended(spark):
    items = spark.createDataFrame([(1, [1], [2, 3]), (2, [], None)], "id long, labels array<int>, found array<int>")
    assert {r.id: r.labels for r in models.merged_labels(items, "found").collect()} == {1: [1, 2, 3], 2: []}
    assert models.merged_labels(items, "found").select(F.size("labels")).count() == 2


def test_models_are_functions_of_sql(spark, monkeypatch):
    monkeypatch.setattr(models, "_models", {})
    monkeypatch.setattr(models, "_extras", {})

    class Splitter:
        def __call__(self, values):
            return [v.split() for v in values]  # fails on null

    models.register("split it", "array<string>")(Splitter)
    assert models.to_sql(spark, "my_") == {"split it": "my_split_it"}
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "id long, name string")
    found = spark.sql("SELECT id, word, a.error IS NULL AS good FROM (SELECT id, my_split_it(name) AS a FROM {items}) LATERAL VIEW OUTER explode(a.result) AS word", items=items)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a", True), (1, "b", True), (2, None, False), (3, None, True), (4, "c", True)]
    assert spark.sql("SELECT my_split_it(name) FROM {items} WHERE id > 9", items=items).collect() == []
    models.register("split-it", "array<string>")(Splitter)
    with pytest.raises(ValueError, match="split_it"):
        models.to_sql(spark)


def test_functions_of_spark_are_not_hidden(spark, monkeypatch):
    monkeypatch.setattr(models, "_models", {})
    monkeypatch.setattr(models, "_extras", {})
    models.register("Length", "array<string>")(lambda: lambda values: [[v] for v in values])
    assert models.to_sql(spark) == models.to_sql(spark) == {"Length": "Length_model"}
    row = spark.sql("SELECT length('abc') AS n, Length_model('abc').result AS mine").first()
    assert row.n == 3 and row.mine == ["abc"]
