"""Words of a text cut without patterns."""

import re

import pytest
from pyspark.sql import functions as F

from rollweave.functions.text import BLANKS, WS, flat, word

from rollweave.operators import lines

TEXTS = ["", " ", "a", " a", "12 H3 ", "12  H3　", "{ÉÖ\t34\x85MT/07/046/1234567", "a  b   c", "a\nb\x1cc d", None]


def test_blanks_are_the_class():
    assert {chr(c) for c in range(0x10000) if re.fullmatch(WS, chr(c))} == set(BLANKS)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_words(spark, n):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(rows.select("i", word(flat(F.col("t")), n)).collect())
    for i, t in enumerate(TEXTS):
        words = (t or "").split()
        assert got[i] == (words[n] if n < len(words) else None)


def test_extraction_does_not_list_all_words_by_a_pattern(spark):
    pages = spark.createDataFrame([("d", 1, 3, "x")], "doc_id string, page_no int, page_count int, text string")
    plan = lines.extract_records(lines.page_lines(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
