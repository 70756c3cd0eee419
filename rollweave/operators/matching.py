"""The same person in two rolls, or twice in one, by weighted agreement of fields.

Records are folded into profiles (equal in all compared fields and blocking keys) with a count, so copies are compared once.
Profiles that share a blocking key are candidate pairs, compared inside the tasks that hold the key (``blocks``); each field of a pair agrees to a level. Level weights are given, or
learned from how often each pattern of levels occurs. Pairs over a threshold are edges: ``match_rolls`` assigns one record to one,
``link_by_score`` takes connected groups.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.text import gram_similarity, trigrams
from rollweave.operators import blocks
from rollweave.operators.components import connected
from rollweave.operators.crossroll import compare_rolls
from rollweave.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Weights = Mapping[str, Sequence[int]]
# Profiles of a blocking key that one task meets; larger blocks are spread.
BLOCK_ROWS = 2_000


@dataclass(frozen=True)
class Equal:
    """Level 1 where the values are equal, else 0."""

    field: str
    levels = 2

    def prepared(self) -> dict[str, Column]:
        return {}

    def level(self, years: int) -> Column:
        return (F.col(f"old_{self.field}") == F.col(f"new_{self.field}")).cast("int")

    def told(self, bucket: blocks.Bucket, years: int) -> Callable:
        return blocks.equal(bucket, self.field)


@dataclass(frozen=True)
class Similar:
    """The number of cuts that the trigram similarity of two texts reaches."""

    field: str
    cuts: tuple[float, ...] = (0.4, 0.7, 1.0)

    @property
    def levels(self) -> int:
        return len(self.cuts) + 1

    def prepared(self) -> dict[str, Column]:
        return {f"{self.field}_grams": trigrams(F.col(self.field))}

    def level(self, years: int) -> Column:
        both = gram_similarity(F.col(f"old_{self.field}_grams"), F.col(f"new_{self.field}_grams")).cast("double")
        there = F.col(f"old_{self.field}").isNotNull() & F.col(f"new_{self.field}").isNotNull()
        # One array of one value: the similarity is worked out once for all cuts.
        reached = F.transform(F.array(both), lambda s: sum(((s >= cut).cast("int") for cut in self.cuts), F.lit(0)))[0]
        return F.when(there, reached)

    def told(self, bucket: blocks.Bucket, years: int) -> Callable:
        return blocks.Texts(bucket, self.field, self.cuts).level


@dataclass(frozen=True)
class Moving:
    """Level 1 where a number moved with the years between the rolls, give or take ``slack``."""

    field: str
    slack: int = 1
    levels = 2

    def prepared(self) -> dict[str, Column]:
        return {}

    def level(self, years: int) -> Column:
        return (F.abs(F.col(f"new_{self.field}") - F.col(f"old_{self.field}") - years) <= self.slack).cast("int")

    def told(self, bucket: blocks.Bucket, years: int) -> Callable:
        return blocks.moving(bucket, self.field, years, self.slack)


def profiles(records: DataFrame, record_id: str, comparisons: Sequence, keys: Sequence[str]) -> DataFrame:
    """profile (the smallest id), n, and the compared fields and keys of records that are equal in all of them."""
    columns = list(dict.fromkeys([*(c.field for c in comparisons), *keys]))
    folded = records.groupBy(*columns).agg(F.min(record_id).alias("profile"), F.count("*").alias("n"))
    prepared = {k: v for c in comparisons for k, v in c.prepared().items()}
    return stage(folded.withColumns(prepared) if prepared else folded, "profiles")


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns])


def _array_keys(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}


def candidates(old: DataFrame, new: DataFrame, passes: Sequence[Sequence[str]], ordered: bool = False) -> DataFrame:
    """Pairs of profiles (``old_`` and ``new_`` columns) that agree on all keys of one of the passes, each pair once.

    A key that is an array agrees on any of its elements; a missing key agrees with nothing. Blocks of more than
    ``BLOCK_ROWS`` profiles are spread by a hash of the new side. ordered: pairs of one roll, the smaller profile as old.
    """
    arrays = _array_keys(old), _array_keys(new)

    def agree(key: str) -> Column:
        a, b = F.col(f"old_{key}"), F.col(f"new_{key}")
        left, right = (x if key in held else F.array(x) for x, held in ((a, arrays[0]), (b, arrays[1])))
        return F.coalesce(F.arrays_overlap(left, right), F.lit(False)) if key in arrays[0] | arrays[1] else F.coalesce(a == b, F.lit(False))

    def one(number: int, keys: Sequence[str]) -> DataFrame:
        met = [f"_k{k}" for k in range(len(keys))]

        def keyed(df: DataFrame, side: str, held: set[str]) -> DataFrame:
            out = _named(df, side)
            for name, key in zip(met, keys):
                value = F.col(f"{side}_{key}")
                out = out.withColumn(name, F.explode(F.array_distinct(value)) if key in held else value)
            return out.where(reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in met]))

        left, right = keyed(old, "old", arrays[0]), keyed(new, "new", arrays[1])
        large = right.groupBy(*met).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts")).where("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1))
        left = left.join(large, met, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        right = right.join(large, met, "left").withColumn("_part", F.pmod(F.xxhash64("new_profile"), parts).cast("int")).drop("_parts")
        pairs = left.join(right, [*met, "_part"])
        if ordered:
            pairs = pairs.where("old_profile < new_profile")
        for earlier in passes[:number]:  # found there already
            pairs = pairs.where(~reduce(lambda a, b: a & b, [agree(k) for k in earlier]))
        if any(k in arrays[0] and k in arrays[1] for k in keys):  # may meet on several elements
            pairs = pairs.dropDuplicates(["old_profile", "new_profile"])
        return pairs.drop(*met, "_part")

    return reduce(DataFrame.unionByName, [one(i, keys) for i, keys in enumerate(passes)])


def random_pairs(old: DataFrame, new: DataFrame, each: int = 20) -> DataFrame:
    """About ``each`` partners for every profile, picked by hashes alone: their number grows with the rolls, not with their product."""
    buckets = max(1, new.count() // each)

    def dealt(df: DataFrame, side: str) -> DataFrame:
        return _named(df, side).withColumn("_at", F.pmod(F.xxhash64(F.lit(side), f"{side}_profile"), F.lit(buckets)))

    return dealt(old, "old").join(dealt(new, "new"), "_at").drop("_at")


def levels(pairs: DataFrame, comparisons: Sequence, years: int = 0) -> DataFrame:
    """old, new, old_n, new_n and the level of each field (NULL where a value is missing), as a staged table."""
    told = [c.level(years).alias(f"{c.field}_level") for c in comparisons]
    return stage(pairs.select(F.col("old_profile").alias("old"), F.col("new_profile").alias("new"), "old_n", "new_n", *told), "levels")


def patterns(compared: DataFrame, comparisons: Sequence) -> DataFrame:
    """How many pairs of records show each pattern of levels: at most the product of the fields' levels plus one."""
    return compared.groupBy(*[f"{c.field}_level" for c in comparisons]).agg(F.sum(F.col("old_n") * F.col("new_n")).alias("pairs"))


@dataclass(frozen=True)
class Model:
    """The share of matches among pairs, and each level's chance among matches and among others."""

    share: float
    match: dict[str, list[float]]
    other: dict[str, list[float]]

    def weights(self) -> dict[str, list[int]]:
        """Level weights in hundredths of a bit."""
        return {f: [round(100 * math.log2(a / b)) for a, b in zip(self.match[f], self.other[f])] for f in self.match}

    def threshold(self, probability: float = 0.5) -> int:
        """The sum of weights from which a pair is a match with at least this probability."""
        odds = probability / (1 - probability) * (1 - self.share) / self.share
        return math.ceil(100 * math.log2(odds))


def learn(counts: DataFrame, comparisons: Sequence, random: DataFrame | None = None, rounds: int = 500, still: float = 1e-9) -> Model:
    """Weights by expectation-maximisation over the pattern counts, fields taken as independent given match or not.

    random: pattern counts of random pairs, which give the levels' chances among others. Candidate pairs agree on their blocking keys
    whether they match or not, so they cannot tell these; without ``random`` they are learned along. The driver gets
    the patterns (a few hundred rows), never pairs. Chances are kept off 0 by a ten-thousandth of a pair.
    """
    seen, n = _counted(counts, comparisons)
    if not len(n):
        raise ValueError("no candidate pairs to learn from")
    size = [c.levels for c in comparisons]
    # To begin with, matches mostly show the highest level of a field.
    apart = (seen, n) if random is None else _counted(random, comparisons)
    other = [_shares(apart[0][:, k], apart[1], s) for k, s in enumerate(size)]
    match = [np.array([*[0.2 / (s - 1)] * (s - 1), 0.8]) for s in size]
    share = 0.1
    for _ in range(rounds):
        a, b = share * _chance(seen, match), (1 - share) * _chance(seen, other)
        p = a / (a + b)
        new_share = float((n * p).sum() / n.sum())
        new_match = [_shares(seen[:, k], n * p, s) for k, s in enumerate(size)]
        if random is None:
            other = [_shares(seen[:, k], n * (1 - p), s) for k, s in enumerate(size)]
        moved = max(abs(new_share - share), *(float(np.abs(x - y).max()) for x, y in zip(new_match, match)))
        share, match = new_share, new_match
        if moved < still:
            break
    return Model(share, {c.field: m.tolist() for c, m in zip(comparisons, match)}, {c.field: o.tolist() for c, o in zip(comparisons, other)})


def _counted(counts: DataFrame, comparisons: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern's levels (-1 where a value is missing) and its number of pairs."""
    rows = counts.collect()
    seen = [[-1 if r[f"{c.field}_level"] is None else r[f"{c.field}_level"] for c in comparisons] for r in rows]
    return np.array(seen, dtype=int).reshape(-1, len(comparisons)), np.array([float(r.pairs) for r in rows])


def _shares(level: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    there = level >= 0
    found = np.bincount(level[there], n[there], size) + 1e-4
    return found / found.sum()


def _chance(seen: np.ndarray, chances: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(seen))
    for k, chance in enumerate(chances):
        out *= np.where(seen[:, k] >= 0, chance[seen[:, k]], 1.0)
    return out


def weighed(compared: DataFrame, comparisons: Sequence, weights: Weights, threshold: int) -> DataFrame:
    """old, new, weight of the pairs whose weights add up to the threshold; a missing value weighs nothing."""
    total = F.lit(0)
    for c in comparisons:
        given = F.array(*[F.lit(int(w)) for w in weights[c.field]])
        total = total + F.coalesce(F.get(given, F.col(f"{c.field}_level")), F.lit(0))
    return compared.withColumn("weight", total).where(F.col("weight") >= threshold).select("old", "new", "old_n", "new_n", "weight")


def _meet(old: DataFrame, new: DataFrame, passes: Sequence[Sequence[str]], comparisons: Sequence, years: int, ordered: bool, work: Callable,
          schema: str) -> DataFrame:
    """Rows that ``work`` makes of the pairs that ``candidates`` would list, in the tasks that compare them."""
    columns = list(dict.fromkeys(["profile", "n", *(c.field for c in comparisons), *(k for p in passes for k in p)]))
    grams = [c for c in dict.fromkeys(k for c in comparisons for k in c.prepared())]

    def lean(df: DataFrame) -> DataFrame:
        return df.select(*columns, *[F.array_join(g, "\n").alias(g) for g in grams])

    def prepare(bucket: blocks.Bucket) -> list[Callable]:
        return [c.told(bucket, years) for c in comparisons]

    return blocks.meet(lean(old), lean(new), passes, ordered, prepare, work, schema, BLOCK_ROWS)


def pattern_counts(old: DataFrame, new: DataFrame, passes: Sequence[Sequence[str]], comparisons: Sequence, years: int = 0) -> DataFrame:
    """The ``patterns`` of all candidate pairs, counted where the pairs are compared."""
    size = [c.levels + 1 for c in comparisons]
    fields = [f"{c.field}_level" for c in comparisons]

    def count(bucket: blocks.Bucket, pairs: Iterator) -> pa.Table:
        found = np.zeros(math.prod(size), dtype=np.int64)
        a, b = (values for values, _ in bucket.numbers("n"))
        for i, j, told in pairs:
            code = np.zeros(len(i), dtype=np.int64)
            for level, s in zip(told, size):
                code = code * s + level + 1
            found += np.bincount(code, a[i] * b[j], len(found)).astype(np.int64)
        shown = np.flatnonzero(found)
        columns = [np.asarray(x, dtype=np.int32) - 1 for x in np.unravel_index(shown, size)]
        return pa.table([*[pa.array(x, mask=x < 0) for x in columns], pa.array(found[shown])], names=[*fields, "pairs"])

    counts = _meet(old, new, passes, comparisons, years, False, count, ", ".join([f"{f} int" for f in fields] + ["pairs bigint"]))
    return counts.groupBy(*fields).agg(F.sum("pairs").alias("pairs"))


def _weight(told: Sequence[np.ndarray], comparisons: Sequence, weights: Weights) -> np.ndarray:
    # The last entry is that of level -1, a missing value.
    return sum(np.array([*weights[c.field], 0], dtype=np.int32)[np.minimum(level, len(weights[c.field]))] for level, c in zip(told, comparisons))


def edges(old: DataFrame, new: DataFrame, passes: Sequence[Sequence[str]], comparisons: Sequence, years: int, weights: Weights,
          threshold: int) -> DataFrame:
    """What ``weighed`` keeps of all candidate pairs, weighed where the pairs are compared."""
    def keep(bucket: blocks.Bucket, pairs: Iterator) -> pa.Table:
        rows, ids = [], [s.column("profile") for s in bucket.sides]
        n = [values for values, _ in bucket.numbers("n")]
        for i, j, told in pairs:
            weight = _weight(told, comparisons, weights)
            over = weight >= threshold
            rows.append((i[over], j[over], weight[over]))
        i, j, weight = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(n[0][i].astype(np.int64)), pa.array(n[1][j].astype(np.int64)),
                         pa.array(weight.astype(np.int32))], names=["old", "new", "old_n", "new_n", "weight"])

    kinds = [df.schema["profile"].dataType.simpleString() for df in (old, new)]
    return _meet(old, new, passes, comparisons, years, False, keep, f"old {kinds[0]}, new {kinds[1]}, old_n bigint, new_n bigint, weight int")


def ties(folded: DataFrame, passes: Sequence[Sequence[str]], comparisons: Sequence, weights: Weights, threshold: int) -> DataFrame:
    """``a, b`` that connect the same profiles as all edges over the threshold: each bucket gives one tie a profile at most."""
    def bind(bucket: blocks.Bucket, pairs: Iterator) -> pa.Table:
        mine, theirs, names = bucket.codes("profile")
        up = np.arange(len(names))
        for i, j, told in pairs:
            over = _weight(told, comparisons, weights) >= threshold
            a, b = mine[i[over]], theirs[j[over]]
            while len(a):
                x, y = up[a], up[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
                while (up[up] != up).any():
                    up = up[up]
        tied = np.flatnonzero(up != np.arange(len(up)))
        return pa.table([names.take(pa.array(tied)), names.take(pa.array(up[tied]))], names=["a", "b"])

    kind = folded.schema["profile"].dataType.simpleString()
    return _meet(folded, folded, passes, comparisons, 0, True, bind, f"a {kind}, b {kind}")


def assign(edges: DataFrame) -> DataFrame:
    """old, new, weight, amount, old_from, new_from: profiles matched one to one, copies one each.

    Equal to taking edges one after the other in order of weight, then of the md5 of ``old|new``, each as often as both sides
    have copies left. In a round all edges that are the best of both their ends are taken at once; the hashed order of equal weights keeps
    the rounds few. old_from and new_from say how many copies of the profile earlier rounds took.
    """
    tie = F.md5(F.concat_ws("|", F.col("old").cast("string"), F.col("new").cast("string")))
    edges = stage(edges.select("old", "new", "weight", tie.alias("tie"), F.col("old_n").alias("old_left"), F.col("new_n").alias("new_left"),
                               F.lit(0).cast("bigint").alias("old_from"), F.lit(0).cast("bigint").alias("new_from")), "edges")
    taken = []
    while not edges.isEmpty():
        rest = ["old_left", "new_left", "old_from", "new_from"]

        def best(side: str, edges: DataFrame = edges) -> DataFrame:
            other = "new" if side == "old" else "old"
            # md5 in descending order of weight: the largest of (weight, reversed tie) is the smallest tie.
            return edges.groupBy(side).agg(F.min_by(F.struct(other, "weight", *rest), F.struct((-F.col("weight")).alias("w"), "tie")).alias("_b")).select(
                side, f"_b.{other}", "_b.weight", *[f"_b.{c}" for c in rest])

        mutual = best("old").join(best("new").select("old", "new"), ["old", "new"], "left_semi")
        now = stage(mutual.select("old", "new", "weight", F.least("old_left", "new_left").alias("amount"), "old_from", "new_from"), "taken")
        taken.append(now)
        for side in ("old", "new"):
            used = now.select(side, F.col("amount").alias("_used"))
            edges = edges.join(used, side, "left").withColumns({
                f"{side}_left": F.col(f"{side}_left") - F.coalesce("_used", F.lit(0)),
                f"{side}_from": F.col(f"{side}_from") + F.coalesce("_used", F.lit(0))}).drop("_used").where(f"{side}_left > 0")
        edges = stage(edges, "edges")
    if not taken:
        return edges.select("old", "new", "weight", F.col("old_left").alias("amount"), "old_from", "new_from")
    return reduce(DataFrame.unionByName, taken)


def _members(records: DataFrame, record_id: str, folded: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    """``<side>`` (profile), ``<side>_id`` and the record's place among the profile's copies. A profile that many records share is
    counted in parts, each carried on from the one before."""
    same = reduce(lambda a, b: a & b, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"p.`{c}`")) for c in columns])
    rows = records.alias("r").join(folded.alias("p"), same).select(F.col("p.profile").alias(side), F.col(f"r.`{record_id}`").alias(f"{side}_id"),
                                                                  F.ceil(F.col("p.n") / BLOCK_ROWS).alias("_parts"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(f"{side}_id"), F.col("_parts"))).drop("_parts")
    before = Window.partitionBy(side).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(side, "_part").agg(F.count("*").alias("_n")).select(side, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(side, "_part").orderBy(f"{side}_id")
    return rows.withColumn("_nth", F.row_number().over(within) - 1).join(bases, [side, "_part"]).select(
        side, f"{side}_id", (F.col("_base") + F.col("_nth")).alias(f"{side}_place"))


def match_rolls(old: DataFrame, new: DataFrame, record_id: str, comparisons: Sequence, passes: Sequence[Sequence[str]], years: int,
                weights: Weights | None = None, threshold: int | None = None) -> DataFrame:
    """old_id, new_id, weight: each record of one roll with at most one of the other, the best pairs first.

    weights: level weights in hundredths of a bit for each field; learned from the candidate and random pairs where None. threshold: the least
    sum of weights; where None, that of an even chance (learned weights only).
    """
    keys = list(dict.fromkeys(k for p in passes for k in p))
    columns = list(dict.fromkeys([*(c.field for c in comparisons), *keys]))
    folded = {"old": profiles(old, record_id, comparisons, keys), "new": profiles(new, record_id, comparisons, keys)}
    if weights is None:
        counts = pattern_counts(folded["old"], folded["new"], passes, comparisons, years)
        apart = levels(random_pairs(folded["old"], folded["new"]), comparisons, years)
        model = learn(counts, comparisons, patterns(apart, comparisons))
        weights, threshold = model.weights(), model.threshold() if threshold is None else threshold
    matched = assign(edges(folded["old"], folded["new"], passes, comparisons, years, weights, threshold))
    left = _members(old, record_id, folded["old"], columns, "old")
    right = _members(new, record_id, folded["new"], columns, "new")
    place = F.col("old_place") - F.col("old_from")
    met = left.join(matched, "old").where((place >= 0) & (place < F.col("amount"))).withColumn("new_place", place + F.col("new_from"))
    return met.join(right, ["new", "new_place"]).select("old_id", "new_id", "weight")


def compare_matched(old: DataFrame, new: DataFrame, record_id: str, matched: DataFrame, fields: Sequence[str], years: int,
                    age: str = "age", slack: int = 1) -> DataFrame:
    """``compare_rolls`` of the records that ``match_rolls`` put together; ``person`` is struct(old_id, new_id), NULL on the side without."""
    matched = stage(matched, "matched")  # both sides need it
    ids = old.select(F.col(record_id).alias("old_id")).join(matched, "old_id", "left")
    left = old.join(ids, old[record_id] == ids["old_id"]).select(F.struct("old_id", "new_id").alias("person"), *fields, age)
    back = new.select(F.col(record_id).alias("new_id")).join(matched, "new_id", "left")
    right = new.join(back, new[record_id] == back["new_id"]).select(F.struct("old_id", "new_id").alias("person"), *fields, age)
    return compare_rolls(left, right, ["person"], fields, years, age, slack)


def link_by_score(records: DataFrame, record_id: str, comparisons: Sequence, passes: Sequence[Sequence[str]], weights: Weights,
                  threshold: int) -> DataFrame:
    """``record_id, canonical_id``: records tied by pairs over the threshold, directly or through others, get the smallest id among them.

    Records that are equal in all fields and keys are one node. Blocks are spread (``candidates``), groups are found by alternating stars.
    """
    keys = list(dict.fromkeys(k for p in passes for k in p))
    columns = list(dict.fromkeys([*(c.field for c in comparisons), *keys]))
    folded = profiles(records, record_id, comparisons, keys)
    groups = connected(ties(folded, passes, comparisons, weights, threshold))
    labels = folded.join(groups, F.col("profile") == F.col("node"), "left").select(
        *columns, F.coalesce("component", "profile").alias("canonical_id"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"l.`{c}`")) for c in columns])
    return records.alias("r").join(labels.alias("l"), same).select(F.col(f"r.`{record_id}`").alias(record_id), F.col("l.canonical_id"))
