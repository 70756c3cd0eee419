"""Scoped name search: substring, fuzzy for one query, fuzzy for many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import (
    at_least, blank_to_null, fold, gram_similarity, normalize_name, query_summary, strip, trigrams,
)

DEFAULT_THRESHOLD = 0.2
MAX_LIMIT = 20
PUBLIC_COLUMNS = (
    "state_id", "ac_number", "part_number", "serial_number", "display_name", "roll_year",
    "roll_kind", "data_quality", "source_label", "confidence", "epic_hint",
)


def redact(records: DataFrame) -> DataFrame:
    """Public form of internal records: name kept, identifier cut to a hint."""
    last4 = blank_to_null(F.col("epic_last4"))
    shown = records.withColumn("display_name", F.col("name")).withColumn(
        "epic_hint", F.when(last4.isNotNull(), F.concat(F.lit("***"), last4))
    )
    return shown.select(*PUBLIC_COLUMNS)


def check_search(query: str, limit: int, threshold: float = 0.0) -> None:
    """Refuse a search whose parameters are out of bounds."""
    if len(" ".join(query.split()).casefold()) < 2:
        raise ValueError("search query must contain at least two normalized characters")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if not 0 <= threshold <= 1:
        raise ValueError("similarity threshold must be between 0 and 1")


def substring_match(name: Column, query: Column) -> Column:
    """Case-folded containment; inner blanks of the name are not squeezed."""
    return F.contains(fold(name), strip(fold(query)))


def substring_search(
    records: DataFrame, state_id: str, ac_number: int, query: str,
    part_number: int | None = None, limit: int = 10,
) -> DataFrame:
    """Public records of one constituency whose name contains the query, most certain first."""
    if len(query.strip()) < 2:
        raise ValueError("query must contain at least two characters")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    scope = (F.col("state_id") == state_id) & (F.col("ac_number") == ac_number)
    if part_number is not None:
        scope = scope & (F.col("part_number") == part_number)
    hits = records.where(scope & substring_match(F.col("name"), F.lit(query)))
    ranked = hits.orderBy(F.col("confidence").desc(), F.coalesce("serial_number", F.lit(0)), "name")
    return redact(ranked.limit(limit))


def scoped_records(
    voters: DataFrame, acs: DataFrame, stations: DataFrame, state_id: str | None = None,
    ac_number: int | None = None, part_number: int | None = None,
) -> DataFrame:
    """Records with constituency and part numbers. Scope filters reach both scans; the part
    filter turns the station join into an inner one."""
    ac = acs.select("ac_id", "ac_number")
    ps = stations.select("polling_station_id", "part_number")
    if state_id is not None:
        voters = voters.where(F.col("state_id") == state_id)
    if ac_number is not None:
        ac = ac.where(F.col("ac_number") == ac_number)
    joined = voters.join(ac, "ac_id").join(ps, "polling_station_id", "left")
    return joined if part_number is None else joined.where(F.col("part_number") == part_number)


def fuzzy_search(
    voters: DataFrame, acs: DataFrame, stations: DataFrame, state_id: str, ac_number: int,
    query: str, limit: int = 10, threshold: float = DEFAULT_THRESHOLD, include_last4: bool = False,
) -> DataFrame:
    """Best matches of one name in one constituency, by trigram similarity then serial."""
    if not state_id:
        raise ValueError("state_id is required")
    if ac_number <= 0:
        raise ValueError("ac_number must be positive")
    check_search(query, limit, threshold)
    grams = trigrams(normalize_name(F.lit(query)))
    stored = F.col("name_trigrams") if "name_trigrams" in voters.columns else trigrams(F.col("name_normalized"))
    scoped = scoped_records(voters, acs, stations, state_id, ac_number).withColumn("_grams", stored)
    scored = keep_scores(scoped, gram_similarity(F.col("_grams"), grams), threshold)
    top = scored.orderBy(
        F.col("score").desc(), F.col("serial_number").asc_nulls_last(), "voter_record_id"
    ).limit(limit)
    columns = [
        F.col("name_original").alias("name"), "age", "gender", "relation_type", "ac_number",
        "part_number", "serial_number", F.round(F.col("score").cast("double"), 4).alias("score"),
        "data_quality",
    ]
    return top.select(*columns, *(["epic_last4"] if include_last4 else []))


def with_trigrams(voters: DataFrame) -> DataFrame:
    """Records with their name's trigrams stored, so searches need not cut them again."""
    return voters.withColumn("name_trigrams", trigrams(F.col("name_normalized")))


def keep_scores(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Rows with their ``score`` where it reaches the threshold. A filter on the score would
    be pushed below its projection and work it out twice; a generator is not."""
    kept = F.filter(F.array(score), lambda s: at_least(s, threshold))
    return df.select("*", F.explode(kept).alias("score"))


# Room for the rounding of 4-byte scores, relative to a set's size.
_SLACK = 1.0 - 1e-6


# Bits of a set's signature, in words of 64.
_WORDS = 4


def _postings(df: DataFrame, text: str, scope: list[str]) -> DataFrame:
    """(scope, text, size, gram) of the distinct texts of a table."""
    return (
        df.select(*scope, text).distinct()
        .withColumn("_grams", trigrams(F.col(text)))
        .select(*scope, text, F.size("_grams").alias(f"{text}_n"), F.explode("_grams").alias("gram"))
    )


def _prefix(postings: DataFrame, frequency: DataFrame, scope: list[str], text: str, threshold: float) -> DataFrame:
    """Only the grams of which an item must share one with any partner at the threshold,
    each with the item's size and signature.

    With grams in one global order (rare first), two sets of similarity t share a gram
    within the first n - ceil(t*n) + 1 of each. The signature sets one of 256 bits per gram.
    """
    n = F.col(f"{text}_n")
    bit = F.pmod(F.xxhash64("gram"), F.lit(64 * _WORDS)).cast("int")
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_bit"), F.lit(64)))
    signature = [
        F.bit_or(F.when(F.floor(F.col("_bit") / 64) == w, place).otherwise(F.lit(0).cast("bigint"))).alias(f"{text}_s{w}")
        for w in range(_WORDS)
    ]
    ordered = (
        postings.join(frequency, "gram", "left").withColumn("_bit", bit)
        .groupBy(*scope, text, f"{text}_n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("_order"), *signature)
    )
    keep = (n - F.ceil(n * F.lit(threshold * _SLACK)) + 1).cast("int")
    words = [f"{text}_s{w}" for w in range(_WORDS)]
    return ordered.select(
        *scope, text, f"{text}_n", *words, F.explode(F.slice("_order", F.lit(1), keep)).alias("_g")
    ).select(*scope, text, f"{text}_n", *words, F.col("_g.gram").alias("gram"))


def _may_reach(threshold: float) -> Column:
    """False only for pairs that cannot reach the threshold.

    A bit one signature has and the other lacks stands for at least one gram the other set
    lacks, which bounds the number of common grams from above.
    """
    def lacks(a: str, b: str) -> Column:
        return sum(
            (F.bit_count(F.col(f"{a}_s{w}").bitwiseAND(F.bitwise_not(F.col(f"{b}_s{w}")))) for w in range(_WORDS)),
            F.lit(0),
        )

    q, n = F.col("query_n"), F.col("name_n")
    common = F.least(q - lacks("query", "name"), n - lacks("name", "query"))
    return common * (1 + threshold * _SLACK) >= (q + n) * (threshold * _SLACK)


def similar_names(
    queries: DataFrame, names: DataFrame, scope: list[str], threshold: float, salts: int = 8
) -> DataFrame:
    """(scope, query, name, score) for all distinct texts of a scope at or above the threshold.

    Candidates come from shared prefix grams, never from all pairs of a scope, and a bound
    from sizes and signatures rules most of them out inside the join, before sets are
    compared. The postings of one gram are spread over ``salts`` buckets of the name side,
    each met by its own copy of the query side, so a gram that a third of all names carry
    is not one task. The gram frequencies are one row per distinct gram; Spark broadcasts
    them when they turn out small enough.
    """
    q, n = _postings(queries, "query", scope), _postings(names, "name", scope)
    frequency = n.groupBy("gram").agg(F.count("*").alias("df"))
    q_posts = _prefix(q, frequency, scope, "query", threshold).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    n_posts = _prefix(n, frequency, scope, "name", threshold).withColumn(
        "salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")
    )
    pairs = (
        q_posts.join(n_posts, [*scope, "gram", "salt"]).where(_may_reach(threshold))
        .select(*scope, "query", "name").distinct()
    )
    cut = pairs.withColumns({"_q": trigrams(F.col("query")), "_n": trigrams(F.col("name"))})
    return keep_scores(cut, gram_similarity(F.col("_q"), F.col("_n")), threshold).drop("_q", "_n")


def best_names(matches: DataFrame, k: int, scope: list[str]) -> DataFrame:
    """scope, query, name, score of the names that may hold one of a query's ``k`` first records: ``k`` names at most, and none below names that
    have ``k`` records. ``matches(scope..., query, name, score, _serial, _id, _held)``: a name's first record and number of records."""
    by_query = Window.partitionBy(*scope, "query").orderBy(
        F.col("score").desc(), F.col("_serial").asc_nulls_last(), F.col("_id")
    )
    by_score = Window.partitionBy(*scope, "query").orderBy(F.col("score").desc())
    above = F.sum("_held").over(by_score) - F.sum("_held").over(Window.partitionBy(*scope, "query", "score"))
    return (
        matches.withColumn("_rn", F.row_number().over(by_query)).where(F.col("_rn") <= k)
        .withColumn("_above", above).where(F.col("_above") < k)
        .select(*scope, "query", "name", "score")
    )


def ranked_matches(
    queries: DataFrame, voters: DataFrame, k: int, threshold: float, scope: list[str]
) -> DataFrame:
    """The first ``k`` records of every query of its scope by score, serial and id, scores
    not rounded.

    Distinct texts are compared once. Of each name only its ``k`` first records and of each
    query only its ``k`` best names can be in the answer, so both are cut by a rank (which
    Spark also applies before the shuffle) ahead of joining the records back. Nor can a name be
    in it once the names of higher scores have ``k`` records.
    """
    if threshold <= 0:
        raise ValueError("a batch search needs a threshold above 0")
    q = queries.withColumn("query", normalize_name(F.col("query"))).where(F.length("query") >= 2)
    place = [F.col("serial_number").asc_nulls_last(), F.col("voter_record_id")]
    by_name = Window.partitionBy(*scope, "name_normalized").orderBy(*place)
    firsts = (
        voters.select(*scope, "voter_record_id", "serial_number", "name_normalized")
        .withColumn("_rn", F.row_number().over(by_name)).where(F.col("_rn") <= k)
        .withColumnRenamed("name_normalized", "name")
    )
    held = F.max("_rn").over(Window.partitionBy(*scope, "name"))
    heads = firsts.withColumn("_held", held).where("_rn = 1").select(
        *scope, "name", F.col("serial_number").alias("_serial"), F.col("voter_record_id").alias("_id"), "_held"
    )
    matches = similar_names(q.select(*scope, "query"), heads.select(*scope, "name"), scope, threshold)
    best = best_names(matches.join(heads, [*scope, "name"]), k, scope)
    ranked_in = Window.partitionBy(*scope, "query").orderBy(F.col("score").desc(), *place)
    answers = (
        best.join(firsts.drop("_rn"), [*scope, "name"])
        .withColumn("rank", F.row_number().over(ranked_in)).where(F.col("rank") <= k)
    )
    return q.join(answers, [*scope, "query"])


def fuzzy_search_batch(
    queries: DataFrame, voters: DataFrame, k: int = 10, threshold: float = DEFAULT_THRESHOLD,
    scope: tuple[str, ...] = ("state_id", "ac_number"),
) -> DataFrame:
    """The best ``k`` records for every query of a table, each in its own scope.

    ``queries(query_id, scope..., query)``; ``voters(voter_record_id, scope...,
    serial_number, name_normalized)``.
    """
    return ranked_matches(queries, voters, k, threshold, list(scope)).select(
        "query_id", *scope, "query", "rank", "voter_record_id", "serial_number", "name",
        F.round(F.col("score").cast("double"), 4).alias("score"),
    )


def search_report(results: DataFrame, state_id: str, ac_number: int, query: str, limit: int,
                  threshold: float) -> DataFrame:
    """The result rows folded into one report row (at most 20 results)."""
    rows = F.collect_list(F.struct(*results.columns))
    return results.agg(rows.alias("results")).select(
        F.lit(True).alias("local_only"), F.lit(False).alias("safe_for_public"),
        F.lit(state_id).alias("state_id"), F.lit(ac_number).alias("ac_number"),
        query_summary(F.lit(query)).alias("query_summary"),
        F.lit(float(threshold)).alias("threshold"), F.lit(limit).alias("limit"),
        F.size("results").alias("result_count"),
        F.array_sort("results", lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int"))
                     .otherwise(F.signum(F.coalesce(a["serial_number"], F.lit(2147483647)).cast("long")
                                         - F.coalesce(b["serial_number"], F.lit(2147483647)).cast("long")).cast("int"))).alias("results"),
    )
