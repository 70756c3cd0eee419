"""What each filter removes, in every order the filters can be applied in.

Each filter stores a table of the rows that fail it. A prefix of an order is a set of filters, so all orders share the
prefix sets (32 for five filters). For every filter and every prefix set without it, a left-anti join of the filter's
failing rows with the rows struck by the set gives what the filter removes there, and a left-semi join gives what it finds
gone already. Both joins are made for all prefix sets at once, on (row, set), a key that no group can make hot. The rest
is sums over these counts.

Defined results: a missing text is an empty one; a missing part is the part ''; rows that repeat a doc_id are rows of their
own; a row without a doc_id is never a later copy and makes none; several labels of a doc_id count as good (toxic) if one of
them is; a table without rows gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.llm.common import saved

SPACE = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 6  # n! orders are reported
# Texts held by more rows than this, or than a 100,000th of all rows: at most 100,000 of them, which are broadcast.
HOT_COPIES, MOST_HOT = 1000, 100_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def few_words(text: Column, least: int = 100) -> Column:
    return F.size(_words(text)) < least


def repeating_words(text: Column, percent: int = 80) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(text: Column, percent: int = 10) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.length(text)


def has_any(text: Column, characters: str = "#$%&*|") -> Column:
    return text.rlike("[" + "".join(f"\\{c}" for c in characters) + "]")


FILTERS = {"A": few_words, "B": repeating_words, "C": many_capitals, "D": has_any}
COPIES = "E"


def judged(docs: DataFrame, labels: DataFrame, filters: dict, part: str) -> DataFrame:
    """row, doc_id, part, digest, good, toxic and a flag fails_<filter> for each filter on one text: one scan of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = [failing(text).alias(f"fails_{name}") for name, failing in filters.items()]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *flags)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Row numbers are drawn once: later steps read them from this table.
    return saved(saved(rows, "audit-rows").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]), "audit-judged")


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has too. Texts with many copies are looked up in a broadcast table of at most ``MOST_HOT`` rows."""
    firsts = saved(rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where(
        "_n > 1"), "audit-firsts")
    hot = F.col("_n") > max(HOT_COPIES, rows.count() // MOST_HOT)
    tried = rows.join(F.broadcast(firsts.where(hot).drop("_n")), "digest", "left")
    cold = tried.where("_first IS NULL").drop("_first").join(firsts.where(~hot).drop("_n"), "digest")
    return tried.where("_first IS NOT NULL").unionByName(cold).where("doc_id > _first")


def failing(docs: DataFrame, labels: DataFrame, filters: dict | None = None, part: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """All rows, and for each filter the table of the rows that fail it: row, part, good, toxic."""
    filters = FILTERS if filters is None else filters
    rows = judged(docs, labels, filters, part)
    kept = ("row", "part", "good", "toxic")
    tables = {name: saved(rows.where(F.col(f"fails_{name}")).select(*kept), f"audit-{name}") for name in filters}
    tables[COPIES] = saved(later_copies(rows).select(*kept), f"audit-{COPIES}")
    return rows, tables


def interactions(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """part, filter, prefix (bit set of the filters before it), removed, redundant, good_lost, toxic_lost: a row for every cell."""
    names = sorted(tables)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    prefixes = range(1 << len(names))

    def sets(number: int, inside: bool) -> Column:
        return F.explode(F.array(*[F.lit(p) for p in prefixes if (p >> number & 1) == inside])).alias("prefix")

    def union(frames) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    asked = union(tables[n].select("row", "part", "good", "toxic", F.lit(n).alias("filter"), sets(i, False)) for i, n in enumerate(names))
    struck = union(tables[n].select("row", sets(i, True)) for i, n in enumerate(names))
    cell = ["part", "filter", "prefix"]
    removed = asked.join(struck, ["row", "prefix"], "left_anti").groupBy(*cell).agg(
        F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    redundant = asked.join(struck, ["row", "prefix"], "left_semi").groupBy(*cell).agg(F.count("*").alias("redundant"))
    every = F.array(*[F.struct(F.lit(n).alias("filter"), F.lit(p).alias("prefix")) for i, n in enumerate(names) for p in prefixes if not p >> i & 1])
    cells = rows.groupBy("part").agg(F.count("*").alias("total")).select("part", "total", F.inline(every))
    return cells.join(removed, cell, "left").join(redundant, cell, "left").na.fill(0)


def audit(docs: DataFrame, labels: DataFrame, filters: dict | None = None, part: str = "lang") -> DataFrame:
    """part, filter_order, step and what the filter of that step keeps, removes and costs there.

    filters: name -> failure condition on the text column; the filter ``COPIES`` (later copies of a text) is always added.
    """
    rows, tables = failing(docs, labels, filters, part)
    names = sorted(tables)
    full = (1 << len(names)) - 1
    bit = {n: 1 << i for i, n in enumerate(names)}
    own = Window.partitionBy("part", "filter")
    others = F.create_map(*[F.lit(x) for n in names for x in (n, full - bit[n])])
    orders_of = F.create_map(*[F.lit(x) for k in range(len(names)) for x in (k, factorial(k) * factorial(len(names) - 1 - k))])
    cells = interactions(rows, tables).withColumns({
        "unique_fails": F.max(F.when(F.col("prefix") == others[F.col("filter")], F.col("removed"))).over(own),
        "shapley": F.sum(F.col("removed") * orders_of[F.bit_count("prefix")]).over(own)})
    steps = [("".join(o), k + 1, o[k], sum(bit[n] for n in o[:k])) for o in permutations(names) for k in range(len(names))]
    grid = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, prefix int")  # n! * n rows
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(F.broadcast(grid), ["filter", "prefix"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """DuckDB SQL for audit() over the tables documents and labels: every order's prefixes on every row's failures."""
    return r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
 FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
 FROM documents),
facts AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
 || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
 || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
 FROM docs LEFT JOIN marks USING (doc_id)),
grouped AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
 WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, filter_order[s] AS f, CASE WHEN s = 1 THEN '' ELSE filter_order[1:s - 1] END AS before
 FROM orders, range(1, 6) t(s)),
parts AS (SELECT DISTINCT part FROM facts),
hits AS (SELECT part, filter_order, step, f, before, n, good, toxic, failed,
 contains(failed, f) AS fails, before <> '' AND regexp_matches(failed, '[' || CASE WHEN before = '' THEN '0' ELSE before END || ']') AS gone
 FROM steps, grouped),
told AS (SELECT part, filter_order, step, f,
 coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
 coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed = f), 0) AS unique_fails,
 coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
 FROM hits GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""
