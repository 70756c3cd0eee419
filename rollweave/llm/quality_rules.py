"""Quality rules with thresholds learned from the texts themselves, in DataFrame functions alone.

For each language and source, mergeable quantile sketches hold how the signals are distributed: counts of
the signal's value cut to its six leading bits, so any quantile is known to 1/32 of its value, a sketch has
a few hundred entries whatever the number of rows, and sketches merge by adding counts. A group's sketch is
weighed by its rows, and the merged sketches of its language and of all groups count beside it as ``PRIOR``
rows each: a large group is judged by its own texts, a small one mostly by its relatives, without a switch.

A document is rejected if a signal lies beyond a fence of its group: the upper quantile plus ``reach`` times
its distance from the lower one (and for word lengths as far below the lower one). Signals that are zero in
most texts are measured at the ninth decile (symbols) and the 99th percentile (repeats), where they vary;
a group in which nine texts of ten hold no symbol tolerates none. A distance counts as 1/32 of the upper quantile
at least, the sketch's resolution. No fence holds a fixed share: a signal in another unit has its fence in that unit.

Defined results: a NULL or empty text has no words and fails; NULL languages and sources are groups of their
own; repeated rows each get a row; columns besides those named are ignored; an empty table gives no rows.
Equal three-word windows are found by a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.llm.common import saved

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Signal -> (lower and upper quantile in 1/100, reach, whether there is a fence below too).
# Shares are in 1/10,000, the word length in 1/100 characters.
FENCES = {
    "symbol_share": (50, 90, 3, False),
    "dup_line_share": (50, 99, 1, False),
    "repeat_share": (50, 99, 1, False),
    "word_length": (25, 75, 3, True),
}
# Rows as which the sketch of the language, and that of all groups, count in a group; a row of the group weighs UNIT.
PRIOR = 20
UNIT = 1 << 16
RESOLUTION = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), at - starts[k - 1])))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        same = F.transform(pairs, lambda p, k: F.when(
            ((k > 0) & (p["h"] == pairs[F.greatest(k - 1, F.lit(0))]["h"]))
            | ((k < F.size(pairs) - 1) & (p["h"] == pairs[F.least(k + 1, F.size(pairs) - 1)]["h"])), p["at"]))
        return F.array_sort(F.filter(same, lambda at: at.isNotNull()))

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            _let(_let(pairs, repeated), covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(hashed(words), count))


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup")))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), by_words.alias("_w"), by_lines.alias("_l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n_words, n_repeat = F.col("_w.n_words").cast("long"), F.col("_w.n_repeat_words").cast("long")
    return found.select(
        "doc_id", "lang", "source", n_words.alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.n_dup").cast("long").alias("n_dup_lines"), F.col("_l.n").cast("long").alias("n_lines"),
        n_repeat.alias("n_repeat_words"), ((n_words < 50) | (100 * n_repeat > 50 * n_words)).alias("base_failed"))


def shares(found: DataFrame) -> DataFrame:
    """The signals that have thresholds, as whole numbers."""

    def share(part: str, whole: str, unit: int) -> Column:
        return F.expr(f"{unit} * {part} div greatest({whole}, 1)")

    return found.withColumns({
        "symbol_share": share("n_symbols", "n_words", 10000), "dup_line_share": share("n_dup_lines", "n_lines", 10000),
        "repeat_share": share("n_repeat_words", "n_words", 10000), "word_length": share("word_chars", "n_words", 100)})


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, signal, value, n: how many rows of a group have a signal in the cell that begins at value."""
    cells = rows.select("lang", "source", F.explode(F.array(*(
        F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in FENCES))).alias("_s"))
    cut = F.expr("greatest(length(bin(_s.x)) - 6, 0)")
    value = F.expr("shiftleft(shiftright(_s.x, _cut), _cut)")
    return cells.withColumn("_cut", cut).groupBy("lang", "source", F.col("_s.signal").alias("signal"), value.alias("value")).agg(
        F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches merged over all but the given keys: keys, signal, n, cells (value, n), a few hundred at most."""
    counts = sketch.groupBy(*keys, "signal", "value").agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys, "signal").agg(F.sum("n").alias("n"), F.collect_list(F.struct("value", "n")).alias("cells"))


def quantile(cells: Column, total: Column, percent: Column) -> Column:
    """The first value up to which percent of the weight lies; cells (value, w) in order of value."""

    def step(state: Column, cell: Column) -> Column:
        return F.struct(
            (state["seen"] + cell["w"]).alias("seen"),
            F.when(100 * state["seen"] < percent * total, cell["value"]).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(cells, start, step, lambda state: state["at"])


def weighed(sketch: DataFrame) -> DataFrame:
    """lang, source, signal and the cells (value, w) of the group, of its language and of all, in order of value."""
    own, by_lang, everything = merged(sketch, "lang", "source"), merged(sketch, "lang"), merged(sketch)
    groups = own.alias("o").join(by_lang.alias("l"), F.expr("o.lang <=> l.lang AND o.signal = l.signal")).join(
        everything.alias("e"), F.expr("o.signal = e.signal"))
    cells = F.expr(f"""array_sort(concat(
        transform(o.cells, c -> named_struct('value', c.value, 'w', {UNIT} * c.n)),
        transform(l.cells, c -> named_struct('value', c.value, 'w', {PRIOR * UNIT} * c.n div l.n)),
        transform(e.cells, c -> named_struct('value', c.value, 'w', {PRIOR * UNIT} * c.n div e.n))))""")
    return groups.select("o.lang", "o.source", "o.signal", cells.alias("cells"))


def _of_signal(k: int) -> Column:
    """The k-th entry of the row's signal in FENCES."""
    return F.element_at(F.create_map(*(F.lit(x) for s, f in FENCES.items() for x in (s, f[k]))), F.col("signal"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and of each signal the least and the most that is kept."""
    rows = weighed(sketch).withColumn("total", F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["w"]))
    ends = rows.select("lang", "source", "signal", *(
        quantile(F.col("cells"), F.col("total"), _of_signal(k)).alias(name) for k, name in ((0, "low"), (1, "high"))))
    chosen = ends.withColumn("reach", _of_signal(2) * F.expr(f"greatest(high - low, high div {RESOLUTION})"))
    bounds = []
    for signal, (*_, below) in FENCES.items():
        mine = F.col("signal") == signal
        bounds.append(F.max(F.when(mine, F.col("high") + F.col("reach"))).alias(f"{signal}_most"))
        if below:
            bounds.append(F.max(F.when(mine, F.col("low") - F.col("reach"))).alias(f"{signal}_least"))
    return chosen.groupBy("lang", "source").agg(*bounds)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    found = shares(saved(signals(docs), "signals"))
    limits = thresholds(sketches(found.where(~F.col("base_failed"))))
    inside = ~F.col("base_failed")
    for signal, (*_, below) in FENCES.items():
        inside &= F.col(f"d.{signal}") <= F.col(f"t.{signal}_most")
        if below:
            inside &= F.col(f"d.{signal}") >= F.col(f"t.{signal}_least")
    joined = found.alias("d").join(limits.alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left")
    return joined.select("d.doc_id", "d.n_words", "d.word_chars", "d.n_symbols", "d.n_dup_lines", "d.n_repeat_words",
                         "d.base_failed", F.coalesce(inside, F.lit(False)).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for judge() over the table documents."""
    tests, bounds = [], []
    for signal, (*_, below) in FENCES.items():
        bounds.append(f"max(CASE WHEN signal = '{signal}' THEN high + reach END) AS {signal}_most")
        tests.append(f"d.{signal} <= t.{signal}_most")
        if below:
            bounds.append(f"max(CASE WHEN signal = '{signal}' THEN low - reach END) AS {signal}_least")
            tests.append(f"d.{signal} >= t.{signal}_least")
    long = "\n UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS x FROM shares WHERE NOT base_failed" for s in FENCES)
    fences = ", ".join(f"('{s}', {low}, {high}, {reach})" for s, (low, high, reach, _) in FENCES.items())

    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
wins AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
 FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM wins),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY rid),
base AS (SELECT s.doc_id, s.lang, s.source, CAST(len(words) AS BIGINT) AS n_words,
 CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN hit h USING (rid)),
shares AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 10000 * n_symbols // greatest(n_words, 1) AS symbol_share, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
 10000 * n_repeat_words // greatest(n_words, 1) AS repeat_share, 100 * word_chars // greatest(n_words, 1) AS word_length FROM base),
long AS ({long}),
sketch AS (SELECT lang, source, signal, (x >> CAST(c AS INT)) << CAST(c AS INT) AS value, count(*) AS n
 FROM (SELECT *, greatest(length(bin(x)) - 6, 0) AS c FROM long) GROUP BY ALL),
fences(signal, lo, hi, times) AS (VALUES {fences}),
bylang AS (SELECT lang, signal, value, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, signal) AS total FROM sketch GROUP BY lang, signal, value),
every AS (SELECT signal, value, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY signal) AS total FROM sketch GROUP BY signal, value),
groups AS (SELECT DISTINCT lang, source, signal FROM sketch),
mixed AS (SELECT lang, source, signal, value, {UNIT} * n AS w FROM sketch
 UNION ALL SELECT g.lang, g.source, g.signal, l.value, {PRIOR * UNIT} * l.n // l.total
 FROM groups g JOIN bylang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.signal = l.signal
 UNION ALL SELECT g.lang, g.source, g.signal, e.value, {PRIOR * UNIT} * e.n // e.total FROM groups g JOIN every e ON g.signal = e.signal),
cells AS (SELECT lang, source, signal, value, sum(w) AS w FROM mixed GROUP BY ALL),
ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, signal ORDER BY value) - w AS seen,
 sum(w) OVER (PARTITION BY lang, source, signal) AS total FROM cells),
ends AS (SELECT lang, source, signal, max(times) AS times, max(CASE WHEN 100 * seen < lo * total THEN value END) AS low,
 max(CASE WHEN 100 * seen < hi * total THEN value END) AS high FROM ranked JOIN fences USING (signal) GROUP BY lang, source, signal),
chosen AS (SELECT *, times * greatest(high - low, high // {RESOLUTION}) AS reach FROM ends),
t AS (SELECT lang, source, {", ".join(bounds)} FROM chosen GROUP BY ALL)
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
 coalesce(NOT d.base_failed AND {" AND ".join(tests)}, false) AS kept
FROM shares d LEFT JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source"""
