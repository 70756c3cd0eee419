"""Cover-page metadata: one row of typed fields per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.layout import (
    ADDRESS_NOISE, AREA_BLOCK, AREA_KINDS, COUNTS_FIVE_RE, COUNTS_THREE_RE, DATE, LEGACY_2002,
    MAX_AC_NUMBER, MIN_TOTAL, PINCODE, RollLayout,
)
from rollweave.functions.text import blank_to_null, squeeze, strip
from rollweave.operators.lines import decode_bold

COUNT_FIELDS = ("serial_start", "serial_end", "male_voters", "female_voters", "total_voters")


def _stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), lambda s: strip(s))


def cover_text(c: Column) -> Column:
    """Cover page with every line stripped and bold printing decoded."""
    return F.array_join(F.transform(_stripped_lines(c), decode_bold), "\n")


def _number(c: Column) -> Column:
    return F.coalesce(blank_to_null(c).cast("int"), F.lit(0))


def _address(c: Column) -> Column:
    kept = F.filter(_stripped_lines(strip(c)), lambda s: (s != "") & (s != ADDRESS_NOISE))
    return F.array_join(kept, " ")


_READERS = {"string": strip, "int": _number, "words": squeeze, "address": _address}


def _first_counts(text: Column, pattern: str, width: int) -> Column:
    """First number group on a page that adds up, as a struct of the five count fields."""
    rows = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.regexp_extract_all(m, F.lit("\\d+"), F.lit(0)).cast("array<int>"),
    )
    male, female, total = width - 3, width - 2, width - 1

    def adds_up(r: Column) -> Column:
        good = (r[male] + r[female] == r[total]) & (r[total] > MIN_TOTAL)
        return good & (r[0] == 1) if width == 5 else good

    hit = F.get(F.filter(rows, adds_up), F.lit(0))
    values = [hit[0], hit[1], hit[2], hit[3], hit[4]] if width == 5 else [
        F.lit(0), F.lit(0), hit[0], hit[1], hit[2]
    ]
    return F.when(hit.isNotNull(), F.struct(*[v.alias(n) for v, n in zip(values, COUNT_FIELDS)]))


def count_block(cover: Column, summary: Column) -> Column:
    """Voter counts: five numbers on the cover, then on the last page; else three numbers,
    where the last page wins over the cover."""
    zero = F.struct(*[F.lit(0).alias(n) for n in COUNT_FIELDS])
    return F.coalesce(
        _first_counts(cover, COUNTS_FIVE_RE, 5),
        _first_counts(summary, COUNTS_FIVE_RE, 5),
        _first_counts(summary, COUNTS_THREE_RE, 3),
        _first_counts(cover, COUNTS_THREE_RE, 3),
        zero,
    )


def _fields(full: Column, layout: RollLayout) -> dict[str, Column]:
    out = {
        f.name: _READERS[f.kind](F.regexp_extract(full, f.prefix + f.pattern, f.group))
        for f in layout.cover_fields
    }
    out["state_code"] = F.when(out["state_code"] != "", F.concat(F.lit("S"), out["state_code"])).otherwise("")
    small = out["ac_number"] < MAX_AC_NUMBER
    out["ac_name_encoded"] = F.when(small, out["ac_name_encoded"]).otherwise("")
    out["ac_number"] = F.when(small, out["ac_number"]).otherwise(0)
    dates = F.regexp_extract_all(full, F.lit(DATE), F.lit(1))
    out["qualification_date"] = F.coalesce(F.get(dates, F.lit(0)), F.lit(""))
    out["publication_date"] = F.coalesce(F.get(dates, F.lit(1)), F.lit(""))
    block = F.regexp_extract(full, "(?s)" + AREA_BLOCK, 0)
    out["area_type_encoded"] = F.coalesce(
        *[F.when(block.contains(kind), kind) for kind in AREA_KINDS], F.lit("")
    )
    # Declared for every document, never filled by this layout.
    out["station_reservation_encoded"] = F.lit("")
    out["station_category_encoded"] = F.lit("")
    return out


def document_pages(pages: DataFrame) -> DataFrame:
    """Cover, second and last page text of each document.

    Only these three pages of a document are kept, by a map-side combined aggregate, so a
    document with very many pages sends three texts per task at most.
    """
    first, last = F.min_by("text", "page_no"), F.max_by("text", "page_no")
    if "page_count" in pages.columns:
        ends = pages.where((F.col("page_no") <= 2) | (F.col("page_no") == F.col("page_count")))
        second = F.max(F.when((F.col("page_no") == 2), F.col("text")))
        return ends.groupBy("doc_id").agg(
            first.alias("cover"), second.alias("second"), last.alias("summary")
        )
    # The two smallest page numbers; the rank filter is applied before the shuffle too. Texts are the bulk of both sides, so neither
    # is ever broadcast.
    ranked = pages.where("page_no IS NOT NULL").withColumn("_rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_no")))
    early = ranked.where("_rank <= 2").groupBy("doc_id").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("text"))).alias("cover"), F.max(F.when(F.col("_rank") == 2, F.col("text"))).alias("second"))
    return pages.groupBy("doc_id").agg(last.alias("summary")).hint("merge").join(early, "doc_id", "left").select(
        "doc_id", "cover", "summary", "second")


def cover_metadata(pages: DataFrame, layout: RollLayout = LEGACY_2002) -> DataFrame:
    """The 28 cover fields per document, defaults ``''`` and 0."""
    docs = document_pages(pages).select(
        "doc_id",
        cover_text(F.col("cover")).alias("_full"),
        decode_bold(F.coalesce("second", F.lit(""))).alias("_second"),
        decode_bold(F.col("summary")).alias("_last"),
    )
    full = F.col("_full")
    pin = F.coalesce(
        blank_to_null(F.regexp_extract(full, PINCODE, 1)),
        F.regexp_extract("_second", PINCODE, 1),
    )
    counts = count_block(full, F.col("_last"))
    with_counts = docs.withColumn("_counts", counts)
    fields = _fields(full, layout)
    return with_counts.select(
        "doc_id",
        *[c.alias(n) for n, c in fields.items()],
        pin.alias("pincode"),
        *[F.col("_counts")[n].alias(n) for n in COUNT_FIELDS],
    )
