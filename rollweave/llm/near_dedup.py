"""Near duplicates by bottom-k sketches.

One hash function orders all shingles; a document's sketch is its ``SKETCH`` smallest. Documents with
equal shingle sets are one class (pre-aggregated), of which only the representative goes on. Inverted lists
of the retained values give candidates. Two linked sets share at least as many retained values as lie six
deviations below the expected number (about one pair in 10**8 does not), so it is enough to list each
document under its rarest values, as many as leave fewer than that many out: very common values hardly ever
are. The union's sketch then estimates the similarity of a candidate pair, and the exact comparison of full
sets decides.

A list is not expanded into all pairs: in each round its ``HUBS`` next members, those first whose values are the
most widely shared (as an original's are among its copies), are compared with the members that do not yet
belong to them, and what links is merged; a list whose members all belong together is done. After the first
round, the shingles that only one of the documents left has are counted: a pair can share no more than the others,
which rules out most members whose own words keep them apart from all. When few pairs between different
components are left, they are all compared (those of long lists in blocks, by bitmaps of the sets in numpy), so no
link between different components is missed.

Defined results: no words or NULL text is an empty set, linked with nothing; fewer words than a shingle are
one shingle; rows that repeat a doc_id are one node and each get a row; a row with NULL doc_id is linked with
nothing and kept; other columns are ignored; an empty table gives no rows. Shingles are compared as 63-bit
hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollweave.llm.common import batch_of, bounded_batches, only_ids, rows_of, saved, texts, without_ids
from rollweave.llm.components import components
from rollweave.llm.wordhash import mixed, shingle_set, word_hashes

SKETCH = 48
HUBS = 4
BITS = 2048
# Rounds of comparing with hubs end when so few pairs for each list entry are left (from the second round on, when the
# bitmaps rule nearly all of them out, LATER times as many), when a round has linked less than this share of the
# pairs it compared, or after so many rounds.
PAIRS_AN_ENTRY = 2
LATER = 400
LINKED_SHARE = 0.02
MOST_ROUNDS = 8
# Lists longer than this are compared in blocks of so many members.
BLOCK = 512
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def least_shared(percent: int) -> int:
    """Retained values that the union sketch of a linked pair shares at least."""
    p = percent / 100
    return math.floor(SKETCH * p - 6 * math.sqrt(SKETCH * p * (1 - p)))


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set, and its sketch."""

    def sketch(batches):
        for ids, some in rows_of(batches, "doc_id", "text"):
            sets = [shingle_set(w, width) for _, part in word_hashes(some, fold=True) for w in part]
            prints = [[int(mixed(s.astype(np.uint64) * np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (3, 5)]
            yield batch_of(_FEATURES, ids, [len(s) for s in sets], *prints, [s[:SKETCH] for s in sets])

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(sketch, "doc_id long, n_shingles long, print_a long, print_b long, sketch array<long>")


def _listed(percent: int) -> F.Column:
    """How many of its rarest values a document is listed under: columns n_shingles, _size (of its sketch)."""
    # A linked partner has at most n * 100 / percent shingles; so many of its values may lie beyond its sketch.
    shared = F.expr(f"CASE WHEN n_shingles >= {SKETCH} THEN {least_shared(percent)} ELSE greatest(1, "
                    f"ceil(n_shingles * {percent} / 100) - greatest(0, floor(n_shingles * 100 / {percent}) - {SKETCH})) END")
    return F.col("_size") - shared + 1


def index(sketches: DataFrame, percent: int) -> DataFrame:
    """value, rep, n_shingles, place: the inverted lists with two members or more, each rep under its rarest values."""
    spread = sketches.select("rep", "n_shingles", F.size("sketch").alias("_size"), F.explode("sketch").alias("value"))
    common = spread.groupBy("value").agg(F.count("*").alias("_df")).where("_df > 1")
    own = Window.partitionBy("rep")
    placed = spread.join(common, "value").withColumns({
        "_rank": F.row_number().over(own.orderBy("_df", "value")), "_there": F.count("*").over(own), "_weight": F.sum("_df").over(own)})
    # Values that no other document has are the rarest and come first.
    listed = placed.where(F.col("_size") - F.col("_there") + F.col("_rank") <= _listed(percent))
    order = Window.partitionBy("value").orderBy(F.desc("_weight"), "rep")
    return listed.select("value", "rep", "n_shingles", (F.row_number().over(order) - 1).alias("place"))


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch shares enough."""
    a, b = (sketches.select(F.col("rep").alias(x), F.col("sketch").alias(f"_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("_union", F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("_a", "_b"), "_union"))
    return both.where(shared * SKETCH >= least_shared(percent) * F.size("_union")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    some = only_ids(texts(docs), wanted)
    a, b = (some.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for left, right, text_a, text_b in rows_of(batches, "a", "b", "text_a", "text_b"):
            distinct = list(dict.fromkeys([*text_a, *text_b]))
            sets = dict(zip(distinct, (shingle_set(w, width) for _, part in word_hashes(distinct, fold=True) for w in part), strict=True))
            good = []
            for x, y in zip(text_a, text_b, strict=True):
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                good.append(100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared) > 0)
            yield batch_of(schema, *([v for v, g in zip(side, good, strict=True) if g] for side in (left, right)))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def bitmaps(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """doc_id, bits: which of ``BITS`` classes of shingles each of the given documents holds; NULL if its rows differ."""
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def mark(batches):
        for ids, some in rows_of(batches, "doc_id", "text"):
            sets = [shingle_set(w, width) for _, part in word_hashes(some, fold=True) for w in part]
            yield batch_of(schema, ids, [np.packbits(np.bincount(s % BITS, minlength=BITS) > 0).view("<i8") for s in sets])

    marked = only_ids(texts(docs), reps).mapInArrow(mark, "doc_id long, bits array<long>")
    return marked.groupBy("doc_id").agg(F.min("bits").alias("bits"), F.max("bits").alias("_most")).select(
        "doc_id", F.when(F.col("bits") == F.col("_most"), F.col("bits")).alias("bits"))


def apart(a: str, b: str) -> F.Column:
    """In how many bits two bitmaps differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITS // 64)), F.lit(0))


def block_pairs(entries: DataFrame, first: int, percent: int) -> DataFrame:
    """a, b: the pairs of long lists that sizes and bitmaps leave, but for those with a member placed before ``first``.

    entries has the columns of the lists with label, most, bits and n (members of the list). A list is dealt by hashes of its
    members into blocks of about ``BLOCK``; a group is two blocks of a list, and compared in numpy.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = entries.where(F.col("place") >= first).withColumn("_own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("value", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "rep", "n_shingles", "most", "label", "bits")

    def compare(table):
        own, rep, size, most, label = (table.column(c).to_numpy() for c in ("_own", "rep", "n_shingles", "most", "label"))
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        rows = table.column("bits").to_pylist()
        known = np.array([r is not None for r in rows])
        bits = np.array([r or [0] * (BITS // 64) for r in rows], dtype=np.int64).view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [np.empty((0, 2), dtype=np.int64)]
        for at in range(0, len(left), 64):
            x, y = left[at : at + 64, None], right[None, :]
            sizes, shared = size[x] + size[y], np.minimum(most[x], most[y])
            close = (label[x] != label[y]) & (shared * 100 >= (sizes - shared) * percent)
            if i == j:
                close &= x < y
            kx, ky = np.nonzero(close)
            x, y, sizes = x[kx, 0], y[0, ky], sizes[kx, ky]
            twice = sizes - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            good = ~(known[x] & known[y]) | (twice * 100 >= (2 * sizes - twice) * percent)
            found.append(np.stack([rep[x[good]], rep[y[good]]], axis=1))
        pairs = np.concatenate(found)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return spread.groupBy("value", "_i", "_j").applyInArrow(compare, "a long, b long")


def shareable(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep, alone: how many shingles no other of the given documents has. reps: a saved table of distinct doc_ids."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches):
        for ids, some in rows_of(batches, "doc_id", "text"):
            yield batch_of(schema, ids, [shingle_set(w, width) for _, part in word_hashes(some, fold=True) for w in part])

    each = only_ids(texts(docs), reps).mapInArrow(sets, "rep long, shingles array<long>").select("rep", F.explode("shingles").alias("s"))
    single = each.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return single.groupBy("rep").agg(F.count("*").alias("alone"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (it is the component's)."""
    found = saved(features(docs, width), "features")
    classed = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["print_a", "print_b", "n_shingles"]
    reps = classed.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = saved(classed.select("doc_id", *key).join(reps, key).select("doc_id", "n_shingles", "rep"), "members")
    rep_ids = members.where("doc_id = rep").select("doc_id")  # the smallest of a class is one of its rows
    sketches = saved(only_ids(classed, rep_ids).select(F.col("doc_id").alias("rep"), "n_shingles", "print_a", "print_b", "sketch").dropDuplicates(
        ["rep", *key]).drop("print_a", "print_b"), "sketches")
    lists = saved(index(sketches, percent), "lists")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, bool]:
        """(links, whether there were few)."""
        distinct = saved(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = saved(verified(saved(estimated(distinct, sketches, percent), "likely"), docs, width, percent), "links")
        return links, links.count() < LINKED_SHARE * distinct.count()

    labels, idle, entries = None, False, lists.withColumns({"label": F.col("rep"), "most": F.col("n_shingles"), "bits": F.lit(None).cast("array<long>")})  # most: shingles that another may share
    for turn in range(MOST_ROUNDS + 1):
        if turn == 1:
            reps_left = saved(entries.select(F.col("rep").alias("doc_id")).distinct(), "left")
            # Where the rows of an id differ, the shingles that are alone are no one row's: none count.
            several = saved(sketches.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("doc_id")), "several")
            alone = without_ids(shareable(docs, reps_left, width).withColumnRenamed("rep", "doc_id"), several)
            known = reps_left.join(alone, "doc_id", "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            known = known.join(bitmaps(docs, reps_left, width), "doc_id").select(
                F.col("doc_id").alias("rep"), F.coalesce("label", "doc_id").alias("label"), F.coalesce("alone", F.lit(0)).alias("alone"), "bits")
            entries = entries.drop("label", "most", "bits").join(saved(known, "known"), "rep").withColumn("most", F.col("n_shingles") - F.col("alone")).drop("alone")
            entries = saved(entries, "labelled")
            least = entries.groupBy("value").agg(F.min("n_shingles").alias("_least"))
            entries = entries.join(least, "value").where(F.col("most") * 100 >= (F.greatest("_least", "most") + F.col("n_shingles") - F.col("most")) * percent).drop("_least")
        elif turn:
            entries = entries.drop("label").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        entries = saved(entries, "labelled") if turn else entries
        by_label = entries.groupBy("value", "label").agg(F.count("*").alias("c"))
        undone = saved(by_label.groupBy("value").agg(F.count("*").alias("labels"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same")).where("labels > 1"), "undone")
        entries = saved(entries.join(undone.select("value"), "value"), "entries")
        left, rows = undone.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if not left:
            break
        last = left <= PAIRS_AN_ENTRY * (LATER if turn else 1) * rows or idle or turn == MOST_ROUNDS
        long = undone.where(F.col("n") > BLOCK).select("value", "n")
        in_blocks = last and turn > 0 and not long.isEmpty()
        joined = entries.join(long, "value", "left_anti") if in_blocks else entries
        a, b = (joined.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", "most", "label", "place", "bits")), F.col("rep").alias(x)) for x in "ab")
        if not last:
            a = a.where((F.col("place_a") >= turn * HUBS) & (F.col("place_a") < (turn + 1) * HUBS))
        most = F.least("most_a", "most_b")
        sizes = F.col("n_shingles_a") + F.col("n_shingles_b")
        close = most * 100 >= (sizes - most) * percent
        if turn:  # twice the shared shingles are the sizes less the difference, and that is no less than the bitmaps'
            twice = sizes - apart("bits_a", "bits_b")
            close &= F.coalesce(twice * 100 >= (2 * sizes - twice) * percent, F.lit(True))
        # Members before this round's hubs were compared with all of the list.
        new = (F.col("place_a") < F.col("place_b")) & (F.col("place_a") >= turn * HUBS)
        pairs = a.join(b, "value").where((F.col("label_a") != F.col("label_b")) & new & close).select("a", "b")
        if in_blocks:
            pairs = pairs.union(block_pairs(entries.join(long, "value"), turn * HUBS, percent))
        links, idle = confirmed(pairs)
        old = links if labels is None else links.union(labels.where("node <> label").select("node", "label"))
        labels = components(old)
        if last:
            break
    if labels is None:
        labels = rep_ids.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).limit(0)
    alone = found.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return alone.union(linked).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which one of each component stays; of rows that repeat a doc_id too."""
    found = saved(near_duplicates(docs, width, percent), "found")
    gone = saved(found.where("NOT kept").select("doc_id").distinct(), "gone")
    if not found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        docs = docs.withColumn("_first", first).where("_first = 1 OR doc_id IS NULL").select(*docs.columns)
    return without_ids(docs, gone)
