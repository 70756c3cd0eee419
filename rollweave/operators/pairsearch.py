"""Search for name and relative's name together, for many queries at once.

Both names must be similar, so a pair may be found by either. Each query looks for candidates by the name whose prefix grams
are rarer among the records, and a pair is formed only if the sizes and signatures of both names allow both thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import at_least, gram_similarity, normalize_name, trigrams
from rollweave.operators.crossroll import ANSWERS, NAME_THRESHOLD
from rollweave.session import stage

_SLACK = 1.0 - 1e-6  # of bounds, for the rounding of 4-byte scores
_WORDS = 4  # of 64 bits in a signature
SIDES = ("name", "relative")


def _sketches(texts: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """text, n, s0.., prefix, cost of distinct texts: number of grams, one of 256 bits for each, the rarest grams of which a
    similar text must have one, and how many postings these have."""
    bit = F.pmod(F.xxhash64("gram"), F.lit(64 * _WORDS)).cast("int")
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_bit"), F.lit(64)))
    signature = [F.bit_or(F.when(F.floor(F.col("_bit") / 64) == w, place).otherwise(F.lit(0).cast("bigint"))).alias(f"s{w}") for w in range(_WORDS)]
    grams = texts.select("text", F.explode(trigrams(F.col("text"))).alias("gram")).join(frequency, "gram", "left").withColumn("_bit", bit)
    told = grams.groupBy("text").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("_order"), F.count("*").cast("int").alias("n"), *signature)
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold * _SLACK)) + 1).cast("int")
    cut = told.withColumn("_order", F.slice("_order", F.lit(1), keep))
    return cut.select("text", "n", *[f"s{w}" for w in range(_WORDS)], F.col("_order.gram").alias("prefix"),
                      F.aggregate(F.col("_order.df"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("cost"))


def _sketched(pairs: DataFrame, scope: Sequence[str], thresholds: dict[str, float], frequency: dict[str, DataFrame]) -> DataFrame:
    """Distinct (scope, name, relative) with the sketches of both as structs; texts without a gram are similar to none and go."""
    out = pairs.select(*scope, *SIDES).distinct()
    for side in SIDES:
        made = _sketches(pairs.select(F.col(side).alias("text")).distinct(), frequency[side], thresholds[side])
        held = made.select(F.col("text").alias(side), F.struct("n", *[f"s{w}" for w in range(_WORDS)], "prefix", "cost").alias(f"{side}_k"))
        out = out.join(held, side)
    return out


def _may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only for texts that cannot reach the threshold by their sizes and signatures."""
    def lacks(x: Column, y: Column) -> Column:
        return sum((F.bit_count(x[f"s{w}"].bitwiseAND(F.bitwise_not(y[f"s{w}"]))) for w in range(_WORDS)), F.lit(0))

    common = F.least(a["n"] - lacks(a, b), b["n"] - lacks(b, a))
    return common * (1 + threshold * _SLACK) >= (a["n"] + b["n"]) * (threshold * _SLACK)


def candidate_pairs(queries: DataFrame, records: DataFrame, scope: Sequence[str], thresholds: dict[str, float]) -> DataFrame:
    """Distinct pairs of (query_name, query_relative) and (name, relative) of a scope that both bounds allow."""
    frequency = {}
    for side in SIDES:
        known = records.select(F.col(side).alias("text")).distinct()
        frequency[side] = stage(known.select(F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "grams")
    asked = _sketched(queries, scope, thresholds, frequency)
    by = F.when(F.col("name_k.cost") <= F.col("relative_k.cost"), "name").otherwise("relative")
    asked = asked.withColumn("_by", by).select(
        *scope, "_by", *[F.col(s).alias(f"query_{s}") for s in SIDES], *[F.col(f"{s}_k").alias(f"query_{s}_k") for s in SIDES],
        F.explode(F.when(F.col("_by") == "name", F.col("name_k.prefix")).otherwise(F.col("relative_k.prefix"))).alias("_gram"))
    held = _sketched(records, scope, thresholds, frequency)

    def entries(side: str) -> Column:
        return F.transform(f"{side}_k.prefix", lambda g: F.struct(F.lit(side).alias("_by"), g.alias("_gram")))

    held = held.select(*scope, *SIDES, *[f"{s}_k" for s in SIDES], F.inline(F.concat(*map(entries, SIDES))))
    bounds = [_may_reach(F.col(f"query_{s}_k"), F.col(f"{s}_k"), thresholds[s]) for s in SIDES]
    return asked.join(held, [*scope, "_by", "_gram"]).where(bounds[0] & bounds[1]).select(
        *scope, "query_name", "query_relative", *SIDES).distinct()


def name_and_relative_search_batch(
    queries: DataFrame, voters: DataFrame, scope: Sequence[str], name_threshold: float = NAME_THRESHOLD,
    relative_threshold: float = NAME_THRESHOLD, k: int = ANSWERS,
) -> DataFrame:
    """query_id, rank, voter_record_id, name_score, relative_score: the best ``k`` records of each query by the sum of both scores.

    ``queries(query_id, scope..., name, relative)``; ``voters(voter_record_id, scope..., name_normalized, relative_name_normalized)``.
    Distinct pairs of names are compared once, and of records with equal names only the ``k`` first can be in an answer.
    """
    thresholds = {"name": name_threshold, "relative": relative_threshold}
    if min(thresholds.values()) <= 0:
        raise ValueError("a batch search needs thresholds above 0")
    asked = queries.select("query_id", *scope, *[normalize_name(F.col(s)).alias(s) for s in SIDES])
    equal = Window.partitionBy(*scope, *SIDES).orderBy("voter_record_id")
    firsts = voters.select("voter_record_id", *scope, F.col("name_normalized").alias("name"), F.col("relative_name_normalized").alias("relative")).withColumn(
        "_rn", F.row_number().over(equal)).where(F.col("_rn") <= k).drop("_rn")
    pairs = candidate_pairs(asked, firsts, scope, thresholds)
    scores = F.struct(*[gram_similarity(trigrams(F.col(f"query_{s}")), trigrams(F.col(s))).alias(f"{s}_score") for s in SIDES])
    # A filter on the scores would work them out twice; a generator does not.
    kept = F.filter(F.array(scores), lambda x: at_least(x["name_score"], name_threshold) & at_least(x["relative_score"], relative_threshold))
    matched = pairs.select("*", F.inline(kept))
    best = Window.partitionBy(*scope, "query_name", "query_relative").orderBy((F.col("name_score") + F.col("relative_score")).desc(), "voter_record_id")
    answers = matched.join(firsts, [*scope, *SIDES]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop(*SIDES)
    named = asked.withColumnsRenamed({s: f"query_{s}" for s in SIDES})
    return named.join(answers, [*scope, "query_name", "query_relative"]).select(
        "query_id", "rank", "voter_record_id", *[F.round(F.col(f"{s}_score").cast("double"), 4).alias(f"{s}_score") for s in SIDES])
