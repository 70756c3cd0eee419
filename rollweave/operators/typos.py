"""Typo-tolerant name search by deletion neighbourhoods.

Two words within d edits (insert, delete, replace, swap of neighbours) have a common form once up to d letters are left out of each. The
index holds the hashes of these forms for every distinct word of the searched fields: 1 + L + L(L-1)/2 rows at most for a word of L
letters and two typos, 56 for ten letters; it grows with the vocabulary and not with the records. Hits are verified by exact distance.
Words that very many records hold are matched by profiles, the distinct sets of such words, and only a profile's first records are an answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import normalize_name
from rollweave.session import stage

# Query words from this length on may have one typo, and two (fixed values).
ONE_TYPO, TWO_TYPOS = 3, 6
# A word of more records than this is not fetched record by record.
HOT = 1000


def _places(length: Column, upto: int = 0) -> Column:
    """1 .. length - upto, or no place."""
    return F.when(length > upto, F.sequence(F.lit(1), length - upto)).otherwise(F.array().cast("array<int>"))


def _without_one(text: Column) -> Column:
    return F.transform(_places(F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def deletions(text: Column, most: Column | int = 2) -> Column:
    """Distinct hashes of a text with up to ``most`` (at most two) letters left out."""
    count = F.lit(most) if isinstance(most, int) else most
    none = F.array().cast("array<string>")
    ones = F.when(count >= 1, F.array_distinct(_without_one(text))).otherwise(none)
    forms = F.transform(F.array(ones), lambda one: F.concat(
        F.array(text), one, F.when(count >= 2, F.flatten(F.transform(one, _without_one))).otherwise(none)))[0]
    return F.array_distinct(F.transform(forms, lambda form: F.xxhash64(form)))


def _swaps(text: Column) -> Column:
    """The text with each two neighbouring letters swapped."""
    return F.transform(_places(F.length(text), 1), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1)), F.substring(text, i, F.lit(1)), F.substring(text, i + 2, F.length(text))))


def typos(a: Column, b: Column) -> Column:
    """The Damerau-Levenshtein distance of two texts up to 2; NULL beyond.

    Two edits with a swap among them are a swap on either side and one edit between the results, or a swap on each side.
    """
    mine, theirs = _swaps(a), _swaps(b)
    both = F.exists(mine, lambda s: F.levenshtein(s, b, 1) >= 0) | F.exists(theirs, lambda s: F.levenshtein(a, s, 1) >= 0) | F.arrays_overlap(mine, theirs)

    def told(plain: Column) -> Column:
        # Each edit is two plain edits at most, so only pairs with three or four need a closer look: swaps keep a text's letters.
        letters = F.levenshtein(*[F.array_join(F.array_sort(F.split(c, "")), "") for c in (a, b)], 2)
        close = ((plain == 3) & (letters >= 0)) | ((plain == 4) & (letters == 0))
        return F.when((plain >= 0) & (plain <= 1), plain).when(plain == 2, F.when(F.array_contains(mine, b), 1).otherwise(2)).when(close & both, 2)

    return F.transform(F.array(F.levenshtein(a, b, 4)), told)[0]


@dataclass(frozen=True)
class TypoIndex:
    """Staged tables: ``records(record_id, words)``, ``postings(word, record_id)``, ``forms(form, word, records)``, ``close_forms`` (those with at
    most one letter left out), ``profiles(record_id, profile)``: a record's words of more than ``hot`` records, sorted, as one text."""

    records: DataFrame
    postings: DataFrame
    forms: DataFrame
    close_forms: DataFrame
    profiles: DataFrame
    hot: int


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(normalize_name(text), " ")), "")


def index(records: DataFrame, record_id: str, fields: Sequence[str], hot: int = HOT) -> TypoIndex:
    """The index over all words of the given fields."""
    words = _words(F.concat_ws(" ", *[F.col(f) for f in fields]))
    held = stage(records.select(F.col(record_id).alias("record_id"), words.alias("words")), "typo-records")
    postings = stage(held.select(F.explode("words").alias("word"), "record_id"), "typo-postings")
    vocabulary = stage(postings.groupBy("word").agg(F.count("*").alias("records")), "typo-vocabulary")

    def forms(most: int) -> DataFrame:
        return stage(vocabulary.select(F.explode(deletions(F.col("word"), most)).alias("form"), "word", "records"), "typo-forms")

    common = vocabulary.where(F.col("records") > hot).select("word")
    profiles = postings.where("record_id IS NOT NULL").join(common, "word").groupBy("record_id").agg(
        F.array_join(F.array_sort(F.collect_set("word")), " ").alias("profile"))
    return TypoIndex(held, postings, forms(2), forms(1), stage(profiles, "typo-profiles"), hot)


def near_words(asked: DataFrame, forms: DataFrame, most: int = 2) -> DataFrame:
    """word, near, typos, records: the vocabulary's words within the typos that a query word's length allows, ``most`` at most. ``asked(word)``."""
    allowed = F.when(F.length("word") >= TWO_TYPOS, most).when(F.length("word") >= ONE_TYPO, 1).otherwise(0)
    tried = asked.select("word", allowed.alias("_most")).distinct()
    cut = tried.select("word", "_most", F.explode(deletions(F.col("word"), F.col("_most"))).alias("form"))
    pairs = cut.join(forms.select("form", F.col("word").alias("near"), "records"), "form").select("word", "_most", "near", "records").distinct()
    # A filter on the distance would work it out twice; a generator does not.
    within = F.filter(F.array(typos(F.col("word"), F.col("near"))), lambda t: t <= F.col("_most"))
    return pairs.select("word", "near", F.explode(within).alias("typos"), "records")


_TEXT = ["_n", "text"]


def _told(held: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """_n, text, key, typos of what holds a near word for every word of the text. ``held(_n, text, key, near)``."""
    by_word = held.join(options.select(*_TEXT, "near", "word", "typos"), [*_TEXT, "near"]).groupBy(*_TEXT, key, "word").agg(F.min("typos").alias("_t"))
    told = by_word.groupBy(*_TEXT, key).agg(F.count("*").alias("_met"), F.sum("_t").cast("int").alias("typos"))
    return told.where("_met = _n").select(*_TEXT, key, "typos")


def _rarest(options: DataFrame) -> DataFrame:
    """_n, text, word, _cost: the word of the fewest postings of each text that has options for all its words."""
    by_word = options.groupBy(*_TEXT, "word").agg(F.sum("records").alias("_cost"))
    rarest = by_word.groupBy(*_TEXT).agg(F.count("*").alias("_met"), F.min(F.struct("_cost", "word")).alias("_r"))
    return rarest.where("_met = _n").select(*_TEXT, "_r.word", "_r._cost")


def _best(single: DataFrame, near: DataFrame, index: TypoIndex, k: int) -> DataFrame:
    """_n, text, record_id, typos: the first ``k`` records of each text by typos and id, as far as ``near`` has their words.

    A text with a word of at most ``hot`` postings is tested against the records of that word. For any other, a record that has one of its rare near
    words is tested itself; what is left matches by hot words alone, so equal profiles match alike and the first ``k`` records of each do.
    """
    options = stage(single.join(near, "word"), "typo-options")
    rarest = stage(_rarest(options), "typo-rarest")
    narrow = options.join(rarest.where(F.col("_cost") <= index.hot).select(*_TEXT, "word"), [*_TEXT, "word"])
    broad = options.join(rarest.where(F.col("_cost") > index.hot).select(*_TEXT), _TEXT)
    by = narrow.unionByName(broad.where(F.col("records") <= index.hot)).select(*_TEXT, F.col("near").alias("word"))
    fetched = by.join(index.postings, "word").select(*_TEXT, "record_id").distinct()
    tested = _told(fetched.join(index.records, "record_id").select(*_TEXT, "record_id", F.explode("words").alias("near")), options, "record_id")

    common = broad.where(F.col("records") > index.hot)
    kinds = index.profiles.select("profile").distinct().select("profile", F.explode(F.split("profile", " ")).alias("near"))
    met = common.join(_rarest(common).select(*_TEXT, "word"), [*_TEXT, "word"]).join(kinds, "near").select(*_TEXT, "profile").distinct()
    alike = _told(met.select(*_TEXT, "profile", F.explode(F.split("profile", " ")).alias("near")), common, "profile")
    first = Window.partitionBy("profile").orderBy("record_id")
    firsts = index.profiles.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_rn")
    whole = tested.unionByName(alike.join(firsts, "profile").drop("profile")).groupBy(*_TEXT, "record_id").agg(F.min("typos").alias("typos"))
    best = Window.partitionBy(*_TEXT).orderBy("typos", "record_id")
    return whole.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn")


def typo_search(queries: DataFrame, index: TypoIndex, k: int = 20) -> DataFrame:
    """query_id, rank, record_id, typos: the records that hold every word of a query but for its typos, fewest typos first.

    ``queries(query_id, query)``. Equal texts are searched once, at first with one typo a word: a text with ``k`` records of one typo in all is
    settled, as every other record has more. Two typos a word, of which there are far more near words, are tried for the others.
    """
    cut = queries.where("query_id IS NOT NULL").select("query_id", _words(F.col("query")).alias("words")).withColumn("_n", F.size("words")).where("_n > 0")
    asked = stage(cut.groupBy("query_id", "_n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")).select(
        "query_id", "_n", F.array_join("words", " ").alias("text")), "typo-queries")
    texts = asked.select(*_TEXT).distinct()
    single = stage(texts.select(*_TEXT, F.explode(F.split("text", " ")).alias("word"), (F.size(F.split("text", " ")) == F.col("_n")).alias("_plain")), "typo-texts")
    plain = single.where("_plain").drop("_plain")
    close = stage(near_words(plain, index.close_forms, 1), "typo-near")
    begun = stage(_best(plain, close, index, k), "typo-begun")
    # Where no word may have two typos, or one of those that may not has no near word, the first search was the whole one.
    short = F.length("word") < TWO_TYPOS
    told = plain.join(close.select("word", F.lit(True).alias("_near")).distinct(), "word", "left").groupBy(*_TEXT).agg(
        (F.min(short) | F.max(short & F.col("_near").isNull())).alias("_whole"))
    settled = told.where("_whole").select(*_TEXT).unionByName(
        begun.where("typos <= 1").groupBy(*_TEXT).count().where(F.col("count") >= k).select(*_TEXT)).distinct()
    settled = stage(settled, "typo-settled")
    open_ = stage(single.drop("_plain").join(settled, _TEXT, "left_anti"), "typo-open")
    rest = _best(open_, stage(near_words(open_, index.forms), "typo-near"), index, k)
    found = begun.join(settled, _TEXT, "left_semi").unionByName(rest)
    best = Window.partitionBy("query_id").orderBy("typos", "record_id")
    return asked.join(found, _TEXT).select("query_id", "record_id", "typos").withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "record_id", "typos")
