"""A document is one plain file."""

import os

from rollweave.plans.files import _written


def test_a_file_for_each_document_and_nothing_beside(spark):
    rows = [(1, '{"a": 1}'), (2, '{"b": "ü"}'), (2, "again"), (None, None)]
    path = _written(spark, spark.createDataFrame(rows, "doc long, value string"), "small")
    held = {name: open(f"{path}/{name}", encoding="utf-8").read() for name in os.listdir(path)}
    assert sorted(held.pop("doc=2.txt").split("\n")) == ["", "again", '{"b": "ü"}']
    assert held == {"doc=1.txt": '{"a": 1}\n', "doc=__HIVE_DEFAULT_PARTITION__.txt": "\n"}
    none = _written(spark, spark.createDataFrame([], "doc long, value string"), "small")
    assert spark.read.text(none).count() == 0
