"""Page text to ordered lines to typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollweave.functions.layout import LEGACY_2002, RollLayout
from rollweave.functions.text import blank_to_null, flat, strip, word
from rollweave.session import stage

BOLD = r"([^\n])\1{3}"
# Pages of one document that are ordered together; a document of any length is spread
# over as many blocks as it needs.
PAGES_PER_BLOCK = 64


def has_bold(c: Column) -> Column:
    """True when some character is printed four or more times in a row."""
    return c.rlike(BOLD)


def decode_bold(c: Column) -> Column:
    """Every run of exactly four equal characters becomes one."""
    return F.regexp_replace(c, BOLD, "$1")


def page_lines(pages: DataFrame) -> DataFrame:
    """Stripped, non-empty lines of all pages but a document's first and last.

    ``pages(doc_id, page_no, text)``. With a ``page_count`` column (pages numbered from 1)
    the cover and summary pages are dropped in place; without it the page bounds come from
    one small pre-aggregated table joined back on the document.
    """
    if "page_count" in pages.columns:
        body = pages.where((F.col("page_no") > 1) & (F.col("page_no") < F.col("page_count")))
    else:
        bounds = pages.groupBy("doc_id").agg(
            F.min("page_no").alias("_first"), F.max("page_no").alias("_last")
        )
        body = pages.join(bounds, "doc_id").where(
            (F.col("page_no") > F.col("_first")) & (F.col("page_no") < F.col("_last"))
        )
    # Stripped before the explode: filters on a generated column stay above the generator,
    # where they would otherwise each carry their own copy of the stripping.
    stripped = F.transform(F.split("text", "\n"), strip)
    return body.select("doc_id", "page_no", F.posexplode(stripped).alias("line_no", "line")).where(
        F.col("line") != ""
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    cases = F.lit(None).cast("string")
    for k, v in table.items():
        cases = F.when(key == k, v).otherwise(cases)
    return cases


def repair_id(tail: Column, layout: RollLayout = LEGACY_2002) -> Column:
    """The full identifier in a line tail, or one joined from two parts and zero-filled to
    seven digits (eight digits are kept), or the empty string."""
    broken = [F.regexp_extract(tail, layout.split_id, i) for i in (1, 2, 3)]
    digits = F.concat(broken[1], broken[2])
    padded = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    return (
        F.when(~tail.contains(layout.id_start), "")
        .when(tail.rlike(layout.full_id), F.regexp_extract(tail, layout.full_id, 0))
        .when(tail.rlike(layout.split_id), F.concat(broken[0], padded))
        .otherwise("")
    )


def quality_flags(name: Column, age: Column, layout: RollLayout = LEGACY_2002) -> Column:
    """Comma-joined issue flags in fixed order, or ``ok``."""
    flags = F.concat_ws(
        ",",
        F.when(name == "", "truncated_line"),
        F.when(age.isNull(), "corrupt_age")
        .when(age.isin(0, -1), "missing_age")
        .when(age < layout.adult_age, "underage"),
    )
    return F.coalesce(blank_to_null(flags), F.lit("ok"))


def is_record(line: Column, layout: RollLayout = LEGACY_2002) -> Column:
    return line.rlike(layout.head) & line.rlike(layout.anchor)


def extract_records(lines: DataFrame, layout: RollLayout = LEGACY_2002) -> DataFrame:
    """Lines that are records, with their typed fields and quality flags. No shuffle."""
    return _with_fields(lines.where(is_record(F.col("line"), layout)), layout)


def _with_fields(kept: DataFrame, layout: RollLayout) -> DataFrame:
    """Record fields of every line.

    The anchor always runs to the end of a stripped line, so it starts at the line length
    less the match length, and the middle lies between it and the head; the two may overlap.
    The steps are separate projections so that no pattern is matched twice.
    """
    c = F.col
    ends = kept.withColumns({
        "_head": F.regexp_extract("line", layout.head, 0),
        "_tail": F.regexp_extract("line", layout.anchor, 0),
    })
    gap = F.greatest(F.length("line") - F.length("_tail") - F.length("_head"), F.lit(0))
    parts = ends.withColumns({
        "_middle": strip(F.substring(c("line"), F.length("_head") + 1, gap)),
        # Words are cut without a pattern: finding them all by one was most of an extraction's time.
        "_first": flat(c("_head")),
        "_last": flat(c("_tail")),
    })
    marked = parts.withColumn("_mark", F.regexp_extract("_middle", layout.relation, 0))
    middle, mark = c("_middle"), c("_mark")
    # The leftmost match is also the first place its text occurs.
    at = F.position(mark, middle)
    years = word(c("_last"), 1).cast("int")
    out = marked.withColumns({
        "serial_number": word(c("_first"), 0).cast("int"),
        "house_number": word(c("_first"), 1),
        "voter_name": F.when(mark == "", middle).otherwise(strip(F.substring(middle, F.lit(1), at - 1))),
        "relation_type": F.when(mark == "", "unknown").otherwise(_lookup(layout.relations, strip(mark))),
        "relative_name": F.when(mark == "", "").otherwise(
            strip(F.substring(middle, at + F.length(mark), F.length(middle)))
        ),
        "gender": _lookup(layout.genders, word(c("_last"), 0)),
        "age": F.when(years.between(layout.min_age, layout.max_age), years),
        "epic_number": repair_id(c("_tail"), layout),
    }).drop("_head", "_tail", "_middle", "_first", "_last", "_mark")
    return out.withColumn("data_quality", quality_flags(c("voter_name"), c("age"), layout))


def _is_section(line: Column, layout: RollLayout) -> Column:
    return has_bold(line) & line.rlike(layout.section) & ~line.rlike(layout.anchor)


def _section(line: Column, layout: RollLayout) -> Column:
    mark = F.regexp_extract(line, layout.section, 0)
    return F.struct(
        F.regexp_extract(line, layout.section, 1).cast("int").alias("number"),
        decode_bold(strip(F.substring(line, F.length(mark) + 1, F.length(line)))).alias("name"),
    )


def section_headers(lines: DataFrame, layout: RollLayout = LEGACY_2002) -> DataFrame:
    """Bold header lines as ``section_number``, ``section_name``. No shuffle."""
    kept = lines.where(_is_section(F.col("line"), layout))
    s = _section(F.col("line"), layout)
    return kept.withColumn("section_number", s["number"]).withColumn("section_name", s["name"])


def carry_forward(
    df: DataFrame, key: str, block: str, order: Sequence[str], value: str, into: str
) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row of its ``key``, in ``order``.

    A plain window over ``key`` would put a hot key into one task. Here rows are ordered
    only inside a (key, block), where block numbers grow with the order; the last value of
    every block goes through a small table (one row per block) that hands each block the
    value it starts with.
    """
    inside = (
        Window.partitionBy(key, block).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.struct(*[F.col(c) for c in order])
    last = (
        df.groupBy(key, block)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_last"))
    )
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(key, block, F.last("_last", ignorenulls=True).over(earlier).alias("_start"))
    local = df.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    return (
        local.join(start, [key, block], "left")
        .withColumn(into, F.coalesce("_local", "_start"))
        .drop("_local", "_start")
    )


def carry_sections(lines: DataFrame, layout: RollLayout = LEGACY_2002, staged: bool = False) -> DataFrame:
    """Records with the section they stand under; (0, '') before a document's first header.

    Fields are extracted ahead of the shuffle, where the scan's own splits do the work. The
    rows are used twice, to order them and to find each block's last header: ``staged``
    writes them to the shared folder in between, so the text is read and parsed once.
    """
    line = F.col("line")
    marked = (
        lines.withColumn("_section", F.when(_is_section(line, layout), _section(line, layout)))
        .where(F.col("_section").isNotNull() | is_record(line, layout))
        .withColumn("_block", F.floor(F.col("page_no") / PAGES_PER_BLOCK))
    )
    fields = _with_fields(marked, layout).drop("line")
    if staged:
        fields = stage(fields, "records")
    carried = carry_forward(fields, "doc_id", "_block", ["page_no", "line_no"], "_section", "_under")
    return (
        carried.where(F.col("_section").isNull())
        .withColumn("section_number", F.coalesce(F.col("_under.number"), F.lit(0)))
        .withColumn("section_name", F.coalesce(F.col("_under.name"), F.lit("")))
        .drop("_section", "_block", "_under")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key. The rank filter is applied before the shuffle too, so a hot
    key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def section_map(headers: DataFrame) -> DataFrame:
    """Per document, the last name seen under each section number (at most 999 entries)."""
    names = headers.groupBy("doc_id", "section_number").agg(
        F.max_by("section_name", F.struct("page_no", "line_no")).alias("section_name")
    )
    return names.groupBy("doc_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("section_number", "section_name")))
        ).alias("sections")
    )


def extract_voters(lines: DataFrame, layout: RollLayout = LEGACY_2002, staged: bool = False) -> DataFrame:
    """All records of all documents: sections carried, first record per serial kept."""
    return first_per_key(carry_sections(lines, layout, staged), ["doc_id", "serial_number"], ["page_no", "line_no"])
