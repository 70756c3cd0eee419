"""JSON exports: what is shuffled and what the files take."""

import gzip
import os
import re
from glob import glob

import pytest
from pyspark.sql import functions as F

from rollweave.operators import lines
from rollweave.operators.ingest import stamp_documents
from rollweave.plans.files import _records
from rollweave.sources import writers

FOLDERS = ("ac_number", "part_number", "year")
LINE = "{} H{} ¶ÉäJÉ {{É ¨Éä½þiÉÉ {{ÉÖ {} MT/07/046/{:07d}"
DOCS = "doc_id long, state_code string, ac_number int, part_number int, revision_year int"


def rows(spark, n=60):
    held = [(i % 4, i, 1, LINE.format(i, i % 7, 10 + i, i)) for i in range(n)]
    # No record, twice the same line, a document without folders, one that is not known, no document, no text.
    held += [(0, 90, 1, "total"), *[(1, 91, 1, LINE.format(1, 1, 30, 1))] * 2, (7, 92, 1, LINE.format(2, 1, 30, 2))]
    held += [(8, 93, 1, LINE.format(3, 1, 30, 3)), (None, 94, 1, LINE.format(4, 1, 30, 4)), (0, 95, 1, None)]
    found = spark.createDataFrame(held, "doc_id long, page_no int, line_no int, line string")
    docs = spark.createDataFrame([*[(d, "S1", 46, d % 2, 2002) for d in range(4)], (7, None, None, None, None)], DOCS)
    return found, docs


def texts(path):
    """(folder, line) of all files."""
    files = glob(f"{path}/**/part-*", recursive=True)
    return sorted((os.path.dirname(os.path.relpath(f, path)), x) for f in files
                  for x in (gzip.open if f.endswith(".gz") else open)(f, "rt", encoding="utf-8").read().splitlines())


def test_records_read_after_the_shuffle_are_the_same_lines(spark, tmp_path):
    found, docs = rows(spark)
    stamped = stamp_documents(lines.extract_records(found), docs)
    writers.export_json(stamped, str(tmp_path / "before"), compression="none")
    writers.export_json(stamp_documents(found, docs), str(tmp_path / "after"), _records)
    want = texts(tmp_path / "before")
    assert len(want) == 63 and texts(tmp_path / "after") == want
    assert [r.ac_number for r in spark.read.json(str(tmp_path / "after")).where("page_no = 92").collect()] == [None]


def test_only_lines_of_records_are_shuffled(spark):
    found, docs = rows(spark)
    plan = writers.dealt(stamp_documents(found, docs), FOLDERS, _records)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    assert "voter_name" in above and "voter_name" not in below and "RLIKE(line" in below and "RLIKE(line" not in above


def test_records_come_in_the_order_of_their_folders(spark):
    # So the writer has nothing to sort.
    found, docs = rows(spark)
    plan = writers.dealt(stamp_documents(found, docs), FOLDERS, _records)._jdf.queryExecution().optimizedPlan()
    assert re.findall(r"(\w+)#\d+ ASC NULLS FIRST", plan.outputOrdering().toString()) == list(FOLDERS)
    tree = plan.toString()
    assert tree.index("Project") < tree.index("Sort [") < tree.index("RebalancePartitions")


@pytest.mark.parametrize("compression, part", [("gzip", 0.2), ("none", 1.0)])
def test_size_of_files(spark, tmp_path, compression, part):
    found, docs = rows(spark, 4000)
    kept = stamp_documents(lines.extract_records(found), docs)
    # As callers write it: gzipped unless they ask for plain text.
    writers.export_json(kept, str(tmp_path), **({} if compression == "gzip" else {"compression": compression}))
    held = texts(tmp_path)
    plain = sum(len(x.encode()) + 1 for _, x in held)
    assert len(held) == 4003 and sum(map(os.path.getsize, glob(f"{tmp_path}/**/part-*", recursive=True))) <= part * plain


def test_a_large_folder_is_several_files(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        many = spark.range(0, 60000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), *[F.lit(1).alias(c) for c in FOLDERS])
        writers.export_json(many, str(tmp_path))
    finally:
        spark.conf.set(size, was)
    files = glob(f"{tmp_path}/**/part-*.gz", recursive=True)
    assert len(files) > 4 and max(map(os.path.getsize, files)) < 0.4 * sum(map(os.path.getsize, files))
    assert spark.read.json(str(tmp_path)).agg(F.count_distinct("id")).first()[0] == 60000
