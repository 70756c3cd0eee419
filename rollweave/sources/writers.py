"""Sinks: JSON and CSV exports, small text files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import groupby
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rollweave.functions.glyphs import devanagari_to_latin, to_devanagari

EXPORT_COLUMNS = (
    "serial_number", "section_number", "section_name", "house_number", "voter_name",
    "relation_type", "relative_name", "gender", "age", "epic_number",
    "state_code", "ac_number", "part_number", "year", "data_quality",
)


def export_name(ac: str = "ac_number", part: str = "part_number", year: str = "year"):
    """``ac046_part021_2002`` as a Column."""
    return F.format_string("ac%03d_part%03d_%d", F.col(ac), F.col(part), F.col(year))


def dealt(df: DataFrame, folders: Sequence[str], fields: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows dealt to their folders. ``fields`` adds what is read from each row alone: after shuffle and sort, which so carry less."""
    rows = df.hint("rebalance", *folders)
    # In the order the writer needs: it would sort the wider rows otherwise.
    return fields(rows.sortWithinPartitions(*folders)) if fields else rows


def _by_folder(df: DataFrame, *folders: str, fields: Callable[[DataFrame], DataFrame] | None = None):
    """A writer that replaces the folders it has rows for and leaves all others; few files a folder."""
    return dealt(df, folders, fields).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)


def export_json(
    voters: DataFrame, path: str, fields: Callable[[DataFrame], DataFrame] | None = None, compression: str = "gzip"
) -> None:
    """Records as JSON lines in one folder per constituency, part and year.

    Every line repeats the names of its fields, so plain files are most of the disk of an export: they are gzipped
    (``compression="none"``: plain). One task reads a gzipped file; a large folder is dealt over several. ``fields``
    as in :func:`dealt`.
    """
    writer = _by_folder(voters, "ac_number", "part_number", "year", fields=fields)
    writer.option("compression", compression).option("zlib.compress.level", "THREE").json(path)


def export_documents(metadata: DataFrame, path: str) -> None:
    """Document metadata and totals, in a tree of their own (not the records')."""
    _by_folder(metadata, "ac_number", "part_number", "year").json(path)


def export_csv(voters: DataFrame, path: str) -> None:
    cols = [c for c in EXPORT_COLUMNS if c in voters.columns]
    _by_folder(voters.select(*cols, export_name().alias("file")), "file").option("header", True).csv(path)


def enrich_names(df: DataFrame, columns: tuple[str, ...] = ("voter_name", "relative_name")) -> DataFrame:
    """Adds ``<name>_dev`` and ``<name>_en`` for every glyph column. No shuffle."""
    out = df
    for c in columns:
        out = out.withColumn(f"{c}_dev", to_devanagari(F.col(c)))
        out = out.withColumn(f"{c}_en", devanagari_to_latin(F.col(f"{c}_dev")))
    return out


def export_enriched(voters: DataFrame, path: str) -> None:
    enrich_names(voters).write.mode("overwrite").json(path)


def on_mounted_disk(spark: SparkSession, path: str) -> bool:
    """Whether a path of the shared folder is one of the machines' own file trees and not of a remote store."""
    scheme = urlsplit(path).scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "").scheme
    return scheme in ("", "file")


def local_path(path: str) -> str:
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def write_texts(folder: str, rows: Iterable[Row]) -> None:
    """In a task: rows ``(doc, value)`` in order of ``doc`` as one file a document, a line for each of its rows.

    Spark's own writer makes a folder, a checksum file and three processes that set access rights for each of
    these files, which is most of the time where a file holds one small document.
    """
    for doc, held in groupby(rows, key=lambda r: r["doc"]):
        name = "__HIVE_DEFAULT_PARTITION__" if doc is None else doc  # as partitionBy names it
        with open(f"{folder}/doc={name}.txt", "w", encoding="utf-8", newline="") as out:
            out.writelines(f"{r['value'] or ''}\n" for r in held)
