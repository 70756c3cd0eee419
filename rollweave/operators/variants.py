"""Spellings and phonetic codes of Latin names: several for each, matched by postings.

Letters and groups that transliteration writes in several ways form classes. ``spelling_key`` writes every class in its base form, so
two names are spellings of each other when their keys are equal: the whole lattice of spellings, however large, is one key.
``spellings`` writes the lattice out for a word, for search engines and people. ``phonetic_codes`` gives a word two codes, a close
one and a loose one in which voiced and unvoiced sounds fall together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import normalize_name
from rollweave.session import stage

# Classes of spellings, in this order: pattern and base form. Runs fold too, so a base form is its own key.
CLASSES = (
    ("a+", "a"), ("(?:e*i[ie]*|ee+)", "i"), ("(?:o*u[uo]*|oo+)", "u"), ("[vw]+", "v"), ("s+h*", "s"), ("(?:p+h+|p*fh*)+", "f"), ("[jz]+", "j"),
    *((f"{c}+", c) for c in "bcdghklmnpqrtxy"),
)
# What a base form may be spelled as.
WRITTEN = {"a": ("a", "aa"), "i": ("i", "ee"), "u": ("u", "oo"), "v": ("v", "w"), "s": ("s", "sh"), "f": ("f", "ph"), "j": ("j", "z")}
MOST_SITES = 6
# Sounds of the close code, then what the loose code makes of it. Vowels count at the beginning only.
SOUNDS = (
    ("chh?", "C"), ("sh?", "S"), ("ph|f", "F"), ("kh|ck|[kcq]", "K"), ("gh?", "G"), ("jh?|z", "J"), ("th?", "T"), ("dh?", "D"), ("bh?", "B"),
    ("[vw]", "V"), ("p", "P"), ("x", "KS"), ("m", "M"), ("n", "N"), ("r", "R"), ("l", "L"), ("^[aeiouy]+", "A"), ("[aeiouyh]+", ""),
)
LOOSE = ("CSFGJDBV", "SSPKSTPP")
CODE_LENGTH = 6
# Rows of either side in a cell of pairs.
CELL = 2_000


def spelling_key(c: Column) -> Column:
    """The base form of a normalised name."""
    return reduce(lambda text, one: F.regexp_replace(text, *one), CLASSES, c)


def spellings(word: Column, most_sites: int = MOST_SITES) -> Column:
    """All spellings of a word, its own included, in order. Letters with several forms beyond the first ``most_sites`` stay in base form,
    and doubled consonants are written once, so the array is bounded by 2 ** most_sites + 1; matching by key does not depend on it."""
    choices = F.create_map(*[x for base, forms in WRITTEN.items() for x in (F.lit(base), F.array(*map(F.lit, forms)))])

    def step(state: Column, letter: Column) -> Column:
        open_ = F.coalesce(F.array_contains(F.map_keys(choices), letter) & (state["sites"] < most_sites), F.lit(False))
        forms = F.when(open_, choices[letter]).otherwise(F.array(letter))
        made = F.flatten(F.transform(state["made"], lambda begun: F.transform(forms, lambda form: F.concat(begun, form))))
        return F.struct(made.alias("made"), (state["sites"] + open_.cast("int")).alias("sites"))

    start = F.struct(F.array(F.lit("")).alias("made"), F.lit(0).alias("sites"))
    made = F.aggregate(F.split(spelling_key(word), ""), start, step, lambda state: state["made"])
    return F.array_sort(F.array_distinct(F.array_append(made, word)))


def phonetic_codes(word: Column) -> Column:
    """struct(close, loose) of a normalised word; sounds that repeat count once."""
    text = F.regexp_replace(F.replace(F.replace(F.regexp_replace(word, "[^a-z]", ""), F.lit("ce"), F.lit("se")), F.lit("ci"), F.lit("si")), "^wh", "v")
    close = reduce(lambda sound, one: F.regexp_replace(sound, *one), SOUNDS, text)

    def once(code: Column) -> Column:
        return F.substring(reduce(lambda t, x: F.regexp_replace(t, f"{x}+", x), "ABCDFGJKLMNPRSTV", code), 1, CODE_LENGTH)

    return F.struct(once(close).alias("close"), once(F.translate(close, *LOOSE)).alias("loose"))


def with_variants(records: DataFrame, name: str) -> DataFrame:
    """Columns worked out once at ingest: name_key, name_spellings (of the words) and name_codes."""
    normal = normalize_name(F.col(name))
    words = F.array_remove(F.split(normal, " "), "")
    return records.withColumns({
        "name_key": spelling_key(normal), "name_spellings": F.transform(words, spellings), "name_codes": F.transform(words, phonetic_codes)})


def spelling_search(queries: DataFrame, records: DataFrame, cell: int = CELL) -> DataFrame:
    """query_id, record_id of the records whose name is a spelling of the query: an equality of keys. ``queries(query_id, query)``, ``records(record_id, name_key)``.

    The pairs are the answer, and those of a key may be very many. They are dealt over tasks in cells of about ``cell`` by ``cell`` rows; the tasks grow
    in number with the pairs, and not in length.
    """
    asked = stage(queries.select("query_id", spelling_key(normalize_name(F.col("query"))).alias("name_key")).where("name_key <> ''"), "spelling-queries")
    held = stage(records.select("record_id", "name_key"), "spelling-records")
    sizes = stage(asked.groupBy("name_key").agg(F.count("*").alias("_q")).join(held.groupBy("name_key").agg(F.count("*").alias("_r")), "name_key"), "spelling-sizes")
    pairs = sizes.agg(F.sum(F.col("_q").cast("double") * F.col("_r"))).first()[0] or 0
    tasks = int(pairs // (cell * cell)) + 1

    def dealt(rows: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        """Each row in one strip of its key's own rows, once for each strip of the other side."""
        strips = {side: F.ceil(F.col(f"_{side}") / cell).cast("int") for side in (own, other)}
        placed = rows.join(sizes, "name_key").withColumn(f"_{own}s", F.pmod(F.xxhash64(row_id), strips[own]).cast("int"))
        whole = placed.withColumn(f"_{other}s", F.explode(F.sequence(F.lit(0), strips[other] - 1)))
        return whole.select(row_id, "name_key", "_qs", "_rs").repartition(tasks, "name_key", "_qs", "_rs")

    return dealt(asked, "query_id", "q", "r").join(dealt(held, "record_id", "r", "q"), ["name_key", "_qs", "_rs"]).select("query_id", "record_id")


def phonetic_search(queries: DataFrame, records: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, record_id, score: records that have a word for every word of the query, in any order, by either code.

    A word that agrees by the close code counts 1, by the loose code alone 0.5; the score is the mean over the query's words.
    ``queries(query_id, query)``, ``records(record_id, name)``. Distinct names are matched, by postings of their words' codes; a name's
    ``k`` first records can be in an answer and no others.
    """
    def coded(df: DataFrame, text: str) -> DataFrame:
        words = F.array_remove(F.array_distinct(F.split(F.col(text), " ")), "")
        told = df.select(text).distinct().select(text, F.size(words).alias("_n"), F.explode(words).alias("_w")).select(
            text, "_n", "_w", phonetic_codes(F.col("_w")).alias("_c"))
        return told.select(text, "_n", "_w", "_c.close", "_c.loose").where("close <> ''")

    asked = queries.select("query_id", normalize_name(F.col("query")).alias("query"))
    held = records.select("record_id", normalize_name(F.col("name")).alias("name"))
    pairs = coded(asked, "query").select("query", "_n", F.col("_w").alias("_asked"), F.col("close").alias("_close"), "loose").join(
        coded(held, "name").select("name", "close", "loose"), "loose")  # equal close codes have equal loose ones
    by_word = pairs.groupBy("query", "_n", "name", "_asked").agg(F.max(F.when(F.col("_close") == F.col("close"), 1.0).otherwise(0.5)).alias("_s"))
    scored = by_word.groupBy("query", "_n", "name").agg(F.count("*").alias("_met"), F.sum("_s").alias("_s")).where("_met = _n").select(
        "query", "name", F.round(F.col("_s") / F.col("_n"), 4).alias("score"))
    firsts = held.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy("record_id"))).where(F.col("_rn") <= k).drop("_rn")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "record_id")
    answers = scored.join(firsts, "name").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return asked.join(answers, "query").select("query_id", "rank", "record_id", "score")
