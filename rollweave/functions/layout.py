"""Layout profiles: everything the extraction jobs know about one kind of roll."""

from __future__ import annotations

from dataclasses import dataclass, field

from rollweave.functions.text import NON_WS, WS


@dataclass(frozen=True)
class CoverField:
    """One labelled field of the cover page: pattern, group, type and a regex flag prefix."""

    name: str
    pattern: str
    group: int = 1
    kind: str = "string"
    prefix: str = ""


def _w(pattern: str) -> str:
    """Spell the white-space and any-character shorthands out for the Java engine."""
    return pattern.replace("\\s", WS).replace("\\S", NON_WS)


# ---------------------------------------------------------------------------
# Markers, patterns and labels of the 2002 legacy-glyph rolls.
# ---------------------------------------------------------------------------

RELATIONS = {"{É": "husband", "´É": "father"}
GENDERS = {"{ÉÖ": "M", "ºjÉÒ": "F"}

ANCHOR = r"(\{ÉÖ|ºjÉÒ)\s+(-?\d{1,4})(?:\s+MT/\d{2}/\d{3}/[^\n]+)?\s*$"
HEAD = r"^(\d{1,4})\s+(\S+)\s+"
RELATION = r"\s(\{É|´É)\s"
FULL_ID = r"MT/\d{2}/\d{3}/\d{7}"
SPLIT_ID = r"(MT/\d{2}/\d{3}/)(\d{3,4})\s+(\d{1,4})"
SECTION = r"^(\d{1,3})\s+"

COVER_FIELDS = (
    ("state_code", r"BºÉ\s*(\d+)", 1, "string", ""),
    ("state_name_encoded", r"BºÉ\s*\d+\)\s*([^\n]+)", 1, "string", ""),
    ("ac_number", r"xÉÉÆ´É\s+(\d{2,3})\s+([^\n]+?)(?:\s+ªÉÉnùÒ|\s*$)", 1, "int", "(?md)"),
    ("ac_name_encoded", r"xÉÉÆ´É\s+(\d{2,3})\s+([^\n]+?)(?:\s+ªÉÉnùÒ|\s*$)", 2, "string", "(?md)"),
    ("ac_reservation_encoded", r"ÎºlÉiÉÒ\s+(\S+)", 1, "string", ""),
    ("part_number", r"^(0\d{3})$", 1, "int", "(?md)"),
    ("pc_number", r"±ÉÉäEòºÉ¦ÉÉ[^\n]*?:\s*\n\s*(\d{2})([^\n]+)", 1, "int", ""),
    ("pc_name_encoded", r"±ÉÉäEòºÉ¦ÉÉ[^\n]*?:\s*\n\s*(\d{2})([^\n]+)", 2, "string", ""),
    ("revision_year", r"´É¹ÉÇ\s*:\s*(\d{4})", 1, "int", ""),
    ("revision_type_encoded", r"º´É¯õ{É\s*:\s*([^\n]+)", 1, "string", ""),
    ("part_boundary_encoded", r"iÉ{É¶ÉÒ±É\s+(.+?)¨ÉÚ³÷\s+MÉÉÆ´É", 1, "words", "(?s)"),
    ("village_city_encoded", r"¶É½ø®ô([^\n]+)", 1, "string", ""),
    ("taluka_encoded", r"iÉÉ±ÉÖEòÉ\s+([^\n]+)", 1, "string", ""),
    ("district_encoded", r"ÊVÉ±½øÉ\s+([^\n]+)", 1, "string", ""),
    ("polling_station_number", r"Eåòpù\s+[^\n]xÉÖGò¨ÉÉÆEò[^\n]*?:\s*(\d+)\s+([^\n]+?)(?:\s+¨ÉÚ³÷|\n)", 1, "int", ""),
    ("polling_station_name_encoded", r"Eåòpù\s+[^\n]xÉÖGò¨ÉÉÆEò[^\n]*?:\s*(\d+)\s+([^\n]+?)(?:\s+¨ÉÚ³÷|\n)", 2, "string", ""),
    ("polling_station_address_encoded", r"{ÉkÉÉ\s*:\s*(.+?)(?:¨ÉÆbý³÷|iÉÉ±ÉÖEòÉ)", 1, "address", "(?s)"),
)
ADDRESS_NOISE = "ºÉVÉÉ"
DATE = r"(\d{2}/\d{2}/\d{4})"
PINCODE = r"(4\d{5})"
AREA_BLOCK = r"´ÉMÉÔEò®ôhÉ.*?(?:3\.|¨ÉiÉnùÉxÉ EåòpùÉSÉÉ)"
AREA_KINDS = ("¶É½ø®Ò", "OÉÉ¨ÉÒhÉ")
COUNTS_FIVE = r"(\d{1,4})\s+(\d{2,4})\s+(\d{2,4})\s+(\d{2,4})\s+(\d{2,4})"
COUNTS_THREE = r"(\d{2,4})\s+(\d{2,4})\s+(\d{2,4})"
MAX_AC_NUMBER = 300
MIN_TOTAL = 50

# ------------------------- end of fixed values ------------------------------


@dataclass(frozen=True)
class RollLayout:
    """Markers and patterns of one roll layout. A new layout is a new instance, not new code."""

    name: str
    relations: dict[str, str]
    genders: dict[str, str]
    anchor: str
    head: str
    relation: str
    full_id: str
    split_id: str
    section: str
    id_start: str
    cover_fields: tuple[CoverField, ...] = field(default_factory=tuple)
    min_age: int = -1
    max_age: int = 130
    adult_age: int = 17


LEGACY_2002 = RollLayout(
    name="parse_2002",
    relations=RELATIONS,
    genders=GENDERS,
    anchor=_w(ANCHOR),
    head=_w(HEAD),
    relation=_w(RELATION),
    full_id=FULL_ID,
    split_id=_w(SPLIT_ID),
    section=_w(SECTION),
    id_start="MT/",
    cover_fields=tuple(
        CoverField(n, _w(p).replace("{ÉkÉÉ", "\\{ÉkÉÉ").replace("iÉ{É", "iÉ\\{É").replace("õ{É", "õ\\{É"), g, k, pre)
        for n, p, g, k, pre in COVER_FIELDS
    ),
)
COUNTS_FIVE_RE = _w(COUNTS_FIVE)
COUNTS_THREE_RE = _w(COUNTS_THREE)
