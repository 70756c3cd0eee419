"""Names are left out of a batch search once enough records stand above them."""

from rollweave.operators.search import best_names


def test_names_below_enough_records_are_cut(spark):
    rows = [("q", "a", 0.9, None, 5, 2), ("q", "b", 0.8, 1, 1, 2), ("q", "c", 0.8, 2, 2, 9), ("q", "d", 0.8, 3, 3, 1), ("q", "e", 0.5, 1, 4, 1), ("r", "a", 0.4, 1, 5, 2)]
    matches = spark.createDataFrame(rows, "query string, name string, score float, _serial int, _id long, _held int")
    got = {k: {(r["query"], r["name"]) for r in best_names(matches, k, []).collect()} for k in (2, 3, 14, 15)}
    assert got[2] == {("q", "a"), ("r", "a")}
    assert got[3] == {("q", "a"), ("q", "b"), ("q", "c"), ("r", "a")}
    assert got[14] == {("q", n) for n in "abcd"} | {("r", "a")}
    assert got[15] == {("q", n) for n in "abcde"} | {("r", "a")}
