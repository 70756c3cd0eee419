"""Lookups, comparisons and linkage across rolls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import (
    fingerprint, gram_similarity, normalize_name, trigrams,
)
from rollweave.operators.components import connected
from rollweave.operators.search import keep_scores, ranked_matches
from rollweave.session import stage

NAME_THRESHOLD = 0.3
CODE_SCORE = 0.7
CANDIDATES, ANSWERS = 200, 20
TEXT_LAYER_CHARS, TEXT_LAYER_PAGES = 100, 5
ACS_PER_RANGE = 25
MODERN_BLOCK = "\\d+\\s+[A-Z]{3}\\d{7}"


def id_lookup(voters: DataFrame, identifier: str, salt: str) -> DataFrame:
    """Records of one identifier in any scope: an equality on the stored hash."""
    wanted = fingerprint(F.lit(identifier), F.lit(salt))["hash"]
    return voters.where(F.col("epic_hash") == wanted)


def id_lookup_batch(voters: DataFrame, identifiers: DataFrame, salt: str) -> DataFrame:
    """The same for a table of ``identifier`` values."""
    wanted = identifiers.select("identifier").distinct().withColumn(
        "epic_hash", fingerprint(F.col("identifier"), F.lit(salt))["hash"]
    )
    return wanted.where(F.col("epic_hash").isNotNull()).join(voters, "epic_hash")


def name_and_relative_search(
    voters: DataFrame, scope: Column, name: str, relative: str, threshold: float = NAME_THRESHOLD,
    limit: int = ANSWERS,
) -> DataFrame:
    """Records of a scope whose name and relative's name are both similar."""
    mine, theirs = trigrams(normalize_name(F.lit(name))), trigrams(normalize_name(F.lit(relative)))
    cut = voters.where(scope).withColumns({
        "_n": trigrams(F.col("name_normalized")), "_r": trigrams(F.col("relative_name_normalized")),
    })
    by_name = keep_scores(cut, gram_similarity(F.col("_n"), mine), threshold).withColumnRenamed("score", "name_score")
    both = keep_scores(by_name, gram_similarity(F.col("_r"), theirs), threshold).withColumnRenamed("score", "relative_score")
    total = F.col("name_score") + F.col("relative_score")
    return both.drop("_n", "_r").orderBy(total.desc(), "voter_record_id").limit(limit)


def phonetic_code(latin: Column) -> Column:
    return F.soundex(latin)


def with_search_columns(voters: DataFrame, latin: str, relative_latin: str) -> DataFrame:
    """Search columns worked out once at ingest: normal form, code and trigrams of both names."""
    out = voters
    for column, tag in ((latin, "name"), (relative_latin, "relative")):
        normal = normalize_name(F.col(column))
        out = out.withColumn(f"{tag}_latin_normalized", normal)
        out = out.withColumn(f"{tag}_code", phonetic_code(F.col(f"{tag}_latin_normalized")))
        out = out.withColumn(f"{tag}_trigrams", trigrams(F.col(f"{tag}_latin_normalized")))
    return out


def phonetic_lookup(voters: DataFrame, scope: Column, name: str, limit: int = ANSWERS) -> DataFrame:
    """Records of a scope whose stored code equals the query's."""
    hits = voters.where(scope & (F.col("name_code") == phonetic_code(F.lit(name))))
    return hits.orderBy("serial_number", "voter_record_id").limit(limit)


def combined_score(voters: DataFrame, scope: Column, name: str, limit: int = ANSWERS) -> DataFrame:
    """Similarity, or 0.7 where the codes agree, whichever is higher."""
    similar = gram_similarity(F.col("name_trigrams"), trigrams(normalize_name(F.lit(name)))).cast("double")
    code = F.when(F.col("name_code") == phonetic_code(F.lit(name)), F.lit(CODE_SCORE)).otherwise(0.0)
    scored = keep_scores(voters.where(scope), F.greatest(similar, code), NAME_THRESHOLD)
    return scored.orderBy(F.col("score").desc(), "voter_record_id").limit(limit)


def two_phase_search(
    queries: DataFrame, voters: DataFrame, scope: Sequence[str], weights: tuple[float, float, float] = (0.6, 0.3, 0.1),
    candidates: int = CANDIDATES, answers: int = ANSWERS,
) -> DataFrame:
    """Candidates by similarity, then a weighted re-rank on similarity, shared words and code.

    ``queries(query_id, scope..., query)``; ``voters(voter_record_id, scope...,
    name_normalized)``.
    """
    unplaced = voters.withColumn("serial_number", F.lit(None).cast("int"))
    short = ranked_matches(queries, unplaced, candidates, NAME_THRESHOLD, list(scope))
    asked, has = F.split("query", " "), F.split("name", " ")
    words = F.size(F.array_intersect(asked, has)) / F.size(F.array_distinct(asked))
    code = (phonetic_code(F.col("query")) == phonetic_code(F.col("name"))).cast("double")
    rank_score = F.round(weights[0] * F.col("score").cast("double") + weights[1] * words + weights[2] * code, 6)
    final = Window.partitionBy("query_id").orderBy(F.col("rank_score").desc(), "voter_record_id")
    return (
        short.withColumn("rank_score", rank_score)
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= answers)
        .select("query_id", "rank", "voter_record_id", F.round(F.col("score").cast("double"), 4).alias("score"), "rank_score")
    )


def variant_match(voters: DataFrame, variants: Sequence[str], column: str = "name_variants") -> DataFrame:
    """Records one of whose stored spellings is among the asked ones."""
    return voters.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in variants])))


def map_constituencies(voters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with every constituency their old one became: ``mapping(old_ac, new_ac)``."""
    return voters.join(mapping, voters["ac_number"] == mapping["old_ac"]).drop("old_ac")


def compare_rolls(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str],
                  years: int, age: str = "age", slack: int = 1) -> DataFrame:
    """Old and new rows of the same key with a status and the names of the differing fields.

    An age is a difference when it did not move with the years, give or take ``slack``.
    """
    compared = [*fields, age]
    left = old.select(*key, *[F.col(f).alias(f"old_{f}") for f in compared], F.lit(True).alias("_old"))
    right = new.select(*key, *[F.col(f).alias(f"new_{f}") for f in compared], F.lit(True).alias("_new"))
    both = left.join(right, list(key), "full_outer")
    moved = F.abs(F.col(f"new_{age}") - F.col(f"old_{age}") - years) > slack
    differing = F.array_compact(F.array(
        *[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields],
        F.when(moved, F.lit(age)),
    ))
    present = F.col("_old") & F.col("_new")
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.size("differences") > 0, "under_review").otherwise("unchanged")
    )
    none = F.array().cast("array<string>")
    return both.withColumn("differences", F.when(present, differing).otherwise(none)).withColumn(
        "status", status
    ).drop("_old", "_new")


def link_persons(records: DataFrame, record_id: str, keys: Sequence[str]) -> DataFrame:
    """``record_id, canonical_id``: records that share any key value, directly or through
    others, get the smallest id among them.

    Every record is tied to the smallest record of each of its key values, never to all
    other records of a group; the ties' components give the groups.
    """
    tagged = F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys
    ]))
    ties = stage(records.select(F.col(record_id).alias("b"), F.explode(tagged).alias("key")), "ties")
    hubs = ties.groupBy("key").agg(F.min("b").alias("a"))
    groups = connected(ties.join(hubs, "key").select("a", "b"))
    ids = records.select(F.col(record_id).alias("node"))
    return ids.join(groups, "node", "left").select(
        F.col("node").alias(record_id), F.coalesce("component", "node").alias("canonical_id")
    )


def record_quality(id_text: Column, age: Column, name: Column, gender: Column,
                   weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Share of the four checks a record passes: id format, adult age, a name, a gender."""
    checks = (
        id_text.rlike("^(?:[A-Z]{3}\\d{7}|MT/\\d{2}/\\d{3}/\\d{7})$"), age.between(18, 120),
        F.length(F.trim(name)) > 0, gender.isin("M", "F"),
    )
    total = F.lit(0.0)
    for weight, check in zip(weights, checks):
        total = total + F.when(check, weight).otherwise(0.0)
    return F.round(total, 4)


def route_documents(counts: DataFrame, retry_from: float = 0.9) -> DataFrame:
    """done when all expected records were parsed, retry when most were, else manual."""
    share = F.col("parsed_records") / F.col("expected_records")
    return counts.withColumn(
        "route",
        F.when(F.col("parsed_records") == F.col("expected_records"), "done")
        .when(share >= retry_from, "retry").otherwise("manual"),
    )


def route_layouts(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents with the layout of their font; ``unknown`` when no profile names it."""
    return documents.join(profiles.select("font_name", "layout"), "font_name", "left").withColumn(
        "layout", F.coalesce("layout", F.lit("unknown"))
    )


def searchable_documents(pages: DataFrame) -> DataFrame:
    """Whether a document has a text layer: over 100 characters on one of its first pages."""
    early = pages.where(F.col("page_no") <= TEXT_LAYER_PAGES)
    longest = early.groupBy("doc_id").agg(F.max(F.length(F.trim("text"))).alias("longest_page"))
    return longest.withColumn("searchable", F.col("longest_page") > TEXT_LAYER_CHARS)


def split_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """Record blocks of modern rolls, cut ahead of every serial and identifier."""
    parts = pages.select("*", F.posexplode(F.split(text, f"(?={MODERN_BLOCK})(?<!\\d)")).alias("block_no", "block"))
    return parts.where(F.col("block").rlike(f"^{MODERN_BLOCK}")).drop(text)


def dropdown(tables: dict[str, DataFrame], state_id: str | None = None) -> DataFrame:
    """Constituencies and their parts, sorted, for selection lists."""
    acs = tables["assembly_constituencies"]
    if state_id is not None:
        acs = acs.where(F.col("state_id") == state_id)
    joined = acs.join(tables["polling_stations"].select("ac_id", "part_number"), "ac_id", "left")
    return joined.select("state_id", "ac_number", "name", "part_number").distinct().orderBy(
        "state_id", "ac_number", "part_number"
    )


def nearby_constituencies(acs: DataFrame, reach: int = 1) -> DataFrame:
    """Constituencies of the same district whose numbers lie within ``reach``."""
    shift = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_by")
    near = acs.select("state_id", "district_id", F.col("ac_number").alias("from_ac"), shift).where("_by <> 0")
    near = near.select("state_id", "district_id", "from_ac", (F.col("from_ac") + F.col("_by")).alias("ac_number"))
    return near.join(acs.select("state_id", "district_id", "ac_number", "name"), ["state_id", "district_id", "ac_number"])


def ac_range(ac_number: Column) -> Column:
    """Partition number of a constituency: ranges of 25."""
    return F.floor(ac_number / ACS_PER_RANGE).cast("int")


def write_partitioned(voters: DataFrame, path: str) -> None:
    """Records by state and constituency range, small ranges merged and hot ones split."""
    voters.withColumn("ac_range", ac_range(F.col("ac_number"))).hint("rebalance", "state_id", "ac_range").write.partitionBy(
        "state_id", "ac_range"
    ).parquet(path)
