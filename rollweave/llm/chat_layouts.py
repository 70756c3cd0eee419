"""Chat records of many layouts as canonical turns, by fingerprints of their field paths.

A layout is a declaration: the nested field paths its records have, some of them optional, and which of them give the turns. The
fingerprint of a record is a hash of its paths, sorted, leaving out paths that no layout names, so that further columns change
nothing. Tables have one fingerprint, taken from their schema; JSON records have one each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "conv_id long, turn long, place long, role string, text string"
# Names that other layouts give to the three usual roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Part:
    """One turn of a record: a fixed role and the fields whose texts make it, joined by blank lines."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """Paths in dots, [] for the elements of a list: ``messages[].content``."""

    name: str
    conv_id: str
    optional: tuple[str, ...] = ()
    turn: str | None = None        # a row for each turn: its number, role and text
    role: str | None = None
    text: str | None = None
    each: str | None = None        # a list of turns: role and text are fields of its elements
    parts: tuple[Part, ...] = field(default=())  # a field for each turn

    def paths(self) -> set[str]:
        inner = {self.role, self.text} if self.each is None else {f"{self.each}[].{p}" for p in (self.role, self.text)}
        leaves = {self.conv_id, self.turn, *inner, *chain.from_iterable(p.texts for p in self.parts)} - {None}
        return {up for leaf in leaves for up in _with_parents(leaf)}


def _with_parents(path: str) -> list[str]:
    out, done = [], ""
    for step in path.split("."):
        name, lists = step.rstrip("[]"), step.count("[]")
        done = f"{done}.{name}" if done else name
        out.append(done)
        for _ in range(lists):
            done += "[]"
            out.append(done)
    return out


LAYOUTS = (
    Layout("rows", "conv_id", turn="turn", role="role", text="text"),
    Layout("messages", "conv_id", each="messages", role="role", text="content"),
    Layout("message parts", "conv_id", each="messages", role="role", text="content[].text"),
    Layout("shared", "conv_id", each="conversations", role="from", text="value"),
    Layout("nested", "conv_id", each="data.turns", role="speaker", text="utterance"),
    Layout("prompt", "conv_id", ("system",), parts=(Part("system", ("system",)), Part("user", ("prompt",)), Part("assistant", ("completion",)))),
    Layout("response", "conv_id", ("system",), parts=(Part("system", ("system",)), Part("user", ("prompt",)), Part("assistant", ("response",)))),
    Layout("instruction", "conv_id", ("system", "input"), parts=(
        Part("system", ("system",)), Part("user", ("instruction", "input")), Part("assistant", ("output",)))),
)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Fingerprint -> layout, for every choice of optional paths."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known = set().union(*(layout.paths() for layout in layouts))
        self.by_print: dict[str, tuple[Layout, frozenset[str]]] = {}
        for layout in layouts:
            for gone in chain.from_iterable(combinations(layout.optional, k) for k in range(len(layout.optional) + 1)):
                paths = frozenset(layout.paths() - set(gone))
                other, _ = self.by_print.setdefault(fingerprint(paths), (layout, paths))
                if other is not layout:
                    raise ValueError(f"layouts {other.name} and {layout.name} have the same paths")

    def print_of(self, paths: set[str]) -> str:
        return fingerprint(paths & self.known)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return set().union(*({p} | schema_paths(f.dataType, p) for f in kind.fields for p in [f"{at}.{f.name}" if at else f.name]))
    if isinstance(kind, T.ArrayType):
        return {f"{at}[]"} | schema_paths(kind.elementType, f"{at}[]")
    return set()


def record_paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a parsed JSON record."""
    out: set[str] = set()
    todo = [(value, at)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            inner = [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
            out.update(p for _, p in inner)
            todo += inner
        elif isinstance(value, list) and value:
            out.add(f"{at}[]")
            todo += [(v, f"{at}[]") for v in value]
    return out


def _typed(paths: frozenset[str], conv_id: str, turn: str | None) -> T.StructType:
    """The schema that reads the given paths from JSON: ids and turn numbers as longs, leaves as texts."""
    def kind(at: str) -> T.DataType:
        if f"{at}[]" in paths:
            return T.ArrayType(kind(f"{at}[]"))
        below = sorted(p for p in paths if p.startswith(f"{at}.") and "." not in p[len(at) + 1 :] and not p.endswith("[]"))
        if below:
            return T.StructType([T.StructField(p[len(at) + 1 :], kind(p)) for p in below])
        return T.LongType() if at in (conv_id, turn) else T.StringType()

    return T.StructType([T.StructField(p, kind(p)) for p in sorted(p for p in paths if "." not in p and not p.endswith("[]"))])


def _at(base: Column | None, path: str) -> Column:
    """The column of a path; the texts of the elements of a list are put together."""
    step, *rest = path.split(".", 1)
    name, listed = step.rstrip("[]"), step.endswith("[]")
    here = F.col(f"`{name}`") if base is None else base[name]
    if not listed:
        return _at(here, rest[0]) if rest else here
    return F.array_join(F.transform(here, lambda x: _at(x, rest[0]) if rest else x), "")


def _turn(number: Column, place: Column, role: Column, text: Column) -> Column:
    named = F.lower(F.coalesce(role.cast("string"), F.lit("")))
    usual = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[named]
    return F.struct(number.cast("long").alias("turn"), place.cast("long").alias("place"),
                    F.coalesce(usual, role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns_of(layout: Layout, paths: frozenset[str], base: Column | None = None) -> Column:
    """The turns of one typed row of a layout. A missing list has no turns, an absent optional field no turn."""
    none = F.lit(None)
    if layout.turn is not None:
        return F.array(_turn(_at(base, layout.turn), F.lit(0), _at(base, layout.role), _at(base, layout.text)))
    if layout.each is not None:
        return F.transform(_at(base, layout.each), lambda x, i: _turn(none, i, _at(x, layout.role), _at(x, layout.text)))
    made = []
    for k, part in enumerate(layout.parts):
        there = [_at(base, p) for p in part.texts if p in paths]
        if there:
            said = F.array_join(F.filter(F.array(*[c.cast("string") for c in there]), lambda x: F.length(x) > 0), "\n\n")
            made.append(_turn(none, F.lit(k), F.lit(part.role), said))
    return F.array(*made)


def table_turns(df: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Canonical turns of a typed table; its schema's fingerprint selects the layout."""
    registry = registry or Registry()
    paths = schema_paths(df.schema)
    found = registry.by_print.get(registry.print_of(paths))
    if found is None:
        raise ValueError(f"no layout has the paths {sorted(paths & registry.known)}")
    return df.select(_at(None, found[0].conv_id).cast("long").alias("conv_id"), F.explode(_turns_of(*found)).alias("_t")).select("conv_id", "_t.*")


def fingerprinted(records: DataFrame, column: str, registry: Registry | None = None) -> DataFrame:
    """record, fingerprint, layout of JSON records; the layout is NULL where no mapping has the fingerprint or the record is no JSON object."""
    registry = registry or Registry()
    names = {p: layout.name for p, (layout, _) in registry.by_print.items()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for text in batch.column(0).to_pylist():
                try:
                    record = json.loads(text or "")
                except ValueError:
                    record = None
                prints.append(registry.print_of(record_paths(record)) if isinstance(record, dict) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.string()), pa.array([names.get(p) for p in prints], pa.string())],
                ["record", "fingerprint", "layout"])

    return records.select(F.col(f"`{column}`").cast("string").alias("record")).mapInArrow(told, "record string, fingerprint string, layout string")


def record_turns(told: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Canonical turns of fingerprinted records: each is read with its own layout's schema, all in one pass."""
    registry = registry or Registry()
    conv_id, said = F.lit(None), F.lit(None)
    for print_, (layout, paths) in registry.by_print.items():
        mine = F.col("fingerprint") == print_
        typed = F.from_json("record", _typed(paths, layout.conv_id, layout.turn))
        conv_id = F.when(mine, _at(typed, layout.conv_id).cast("long")).otherwise(conv_id)
        said = F.when(mine, _turns_of(layout, paths, typed)).otherwise(said)
    return told.select(conv_id.alias("conv_id"), F.explode(said).alias("_t")).select("conv_id", "_t.*")
