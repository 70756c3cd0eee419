"""Roll-like text made from the test tables, as SQL text both engines accept."""

from __future__ import annotations


# Names in the legacy glyph code, in Devanagari and in Latin (fixed values).
GLYPH_NAMES = (
    ("¶ÉäJÉ", "शेख", "shekha"),
    ("¨Éä½þiÉÉ", "मेहता", "mehataa"),
    ("{ÉÉ]õÒ±É", "पाटील", "paateela"),
    ("ºÉÉ´ÉÆiÉ", "सावंत", "saavanta"),
    ("Ê´É±ÉÉºÉ", "विलास", "vilaasa"),
    ("ÊxÉVÉÉ¨ÉÖqùÒxÉ", "निजामुद्दीन", "nijaamuddeena"),
    ("{ÉÖ¯û¹ÉÉäkÉ¨É", "पुरुषोत्तम", "purushottama"),
    ("VÉxÉÉnÇùxÉ", "जनार्दन", "janaardana"),
    ("ÊEòiÉÔ", "किर्ती", "kirtee"),
    ("MÉÉÆMÉÖbæ÷", "गांगुडे", "gaangude"),
    ("{ÉÚÌhÉ¨ÉÉ", "पूर्णमा", "poornamaa"),
)


def glyph_name(key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n[0]}'" for i, n in enumerate(GLYPH_NAMES))
    return f"CASE ({key}) % {len(GLYPH_NAMES)} {cases} END"


def _whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


DOC = _whole("o_orderkey / 40")
PAGE = "CAST(o_orderkey % 40 + 1 AS INT)"


def voter_line(j: int) -> str:
    """One roll line of an order: usual, split-id, garbled, truncated and overlapping shapes."""
    k = f"(o_orderkey * 3 + {j})"
    serial = f"({k} % 97 + 1)"
    mark = f"CASE {k} % 9 WHEN 0 THEN ' ' WHEN 1 THEN ' ´É ' ELSE ' {{É ' END"
    gender = f"CASE {k} % 2 WHEN 0 THEN '{{ÉÖ' ELSE 'ºjÉÒ' END"
    age = f"CASE {k} % 50 WHEN 3 THEN -1 WHEN 5 THEN 0 WHEN 7 THEN 5 WHEN 11 THEN 259 ELSE 17 + (o_custkey + {j}) % 80 END"
    ident = (
        f"CASE {k} % 6 WHEN 0 THEN '' WHEN 1 THEN ' MT/07/046/000 360' WHEN 2 THEN ' MT/07/046/20353ÚÆ' "
        f"WHEN 3 THEN ' MT/07/046/1234 5678' ELSE concat(' MT/07/', lpad(concat('', o_custkey % 1000), 3, '0'), '/', lpad(concat('', o_orderkey % 10000000), 7, '0')) END"
    )
    usual = (
        f"concat({serial}, ' H', o_custkey % 500, ' ', {glyph_name(f'o_custkey + {j}')}, {mark}, "
        f"{glyph_name(k)}, ' ', {gender}, ' ', {age}, {ident})"
    )
    return (
        f"CASE WHEN {k} % 37 = 0 THEN concat({serial}, ' ´É {{ÉÖ 1') "
        f"WHEN {k} % 41 = 0 THEN concat({serial}, ' {{ÉÖ 34') "
        f"WHEN {k} % 43 = 0 THEN 'xÉÉÆ´É ªÉÉnùÒ 12' ELSE {usual} END"
    )


def _bold(expr: str, n: int) -> str:
    return "concat(" + ", ".join(f"repeat(substr({expr}, {i}, 1), 4)" for i in range(1, n + 1)) + ")"


# Every eighth order starts a section; the name is printed bold.
SECTION_NUMBER = "(o_custkey % 120 + 1)"
SECTION_NAME = "substr(o_orderpriority, 3, 3)"
SECTION_LINE = (
    f"CASE WHEN o_orderkey % 8 = 1 THEN concat({SECTION_NUMBER}, ' ', {_bold(SECTION_NAME, 3)}) "
    f"WHEN o_orderkey % 8 = 5 THEN '{{ÉÖÉÉÉÉ header' ELSE '' END"
)
PAGE_TEXT = (
    f"concat('  page ', {PAGE}, chr(10), {SECTION_LINE}, chr(10), {voter_line(0)}, chr(10), "
    f"'  ', {voter_line(1)}, '  ', chr(10), '   ', chr(10), {voter_line(2)}, chr(10), 'total')"
)
PAGES_SQL = f"SELECT {DOC} AS doc_id, {PAGE} AS page_no, {PAGE_TEXT} AS text FROM orders"


def page_text(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.selectExpr(
        f"{DOC} AS doc_id", f"{PAGE} AS page_no", f"{PAGE_TEXT} AS text"
    )


# -- cover pages: one three-page document per customer ----------------------------------

_K = "c_custkey"
COVER_LINES = (
    f"concat('BºÉ ', {_K} % 30 + 1, ') Rajya ', {_K} % 7)",
    f"concat('Sabha xÉÉÆ´É  ', {_K} % 340 + 10, ' ', c_mktsegment, ' East  ªÉÉnùÒ 2002')",
    "'  ÎºlÉiÉÒ   GEN open'",
    f"concat('   ', lpad(concat('', {_K} % 99 + 1), 4, '0'))",
    "'±ÉÉäEòºÉ¦ÉÉ xÉÉÆ´É :'",
    f"concat(' ', {_K} % 48 + 50, ' Mumbai North ', {_K} % 5)",
    f"concat('´É¹ÉÇ : ', 2000 + {_K} % 5)",
    "'º´É¯õ{É : Intensive  revision '",
    f"concat('from 01/01/2002 to ', lpad(concat('', {_K} % 27 + 1), 2, '0'), '/03/2002')",
    f"concat('iÉ{{É¶ÉÒ±É  Block ', {_K} % 11, '  to')",
    "'  river road  ¨ÉÚ³÷ MÉÉÆ´É Wadi'",
    f"concat('MÉÉÆ´É/¶É½ø®ô Pur ', {_K} % 3)",
    f"concat('´ÉMÉÔEò®ôhÉ : ', CASE {_K} % 3 WHEN 0 THEN '¶É½ø®Ò' WHEN 1 THEN 'OÉÉ¨ÉÒhÉ' ELSE '-' END, ' 3.')",
    f"concat('Eåòpù +xÉÖGò¨ÉÉÆEò xÉÉÆ´É : ', {_K} % 250 + 1, ' School ', c_mktsegment, '  ¨ÉÚ³÷')",
    f"concat('{{ÉkÉÉ : ', {_K} % 60, ' Main road')",
    "'  ºÉVÉÉ '",
    f"concat('Ward ', {_K} % 9, CASE WHEN {_K} % 3 = 0 THEN '' ELSE concat(' 4', 10101 + {_K} % 777) END)",
    "'¨ÉÆbý³÷ X'",
    f"concat('iÉÉ±ÉÖEòÉ  Taluka ', {_K} % 17)",
    f"concat('ÊVÉ±½øÉ Zilla ', {_K} % 6)",
    f"CASE WHEN {_K} % 4 = 0 THEN concat('1 ', 200 + 2 * ({_K} % 100), ' ', 100 + {_K} % 100, ' ', 100 + {_K} % 100, ' ', 200 + 2 * ({_K} % 100)) "
    f"WHEN {_K} % 4 = 3 THEN concat('x ', 60 + {_K} % 30, ' ', 70, ' ', 130 + {_K} % 30, ' y') ELSE 'counts follow' END",
)
COVER = "concat(" + ", chr(10), ".join(COVER_LINES) + ")"
SECOND = f"concat('pin 4', 20202 + {_K} % 555, ' end')"
SUMMARY = (
    f"CASE {_K} % 4 WHEN 1 THEN concat('total 1 ', 300 + {_K} % 50, ' ', 150, ' ', 150 + {_K} % 50, ' ', 300 + {_K} % 50) "
    f"WHEN 2 THEN concat('sum ', 55, ' ', 65 + {_K} % 20, ' ', 120 + {_K} % 20) ELSE 'end of roll' END"
)


def cover_pages(spark, folder):
    """The three pages of every customer's document, with some bold printing on the cover."""
    texts = f"array({COVER}, {SECOND}, {SUMMARY})"
    customers = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_mktsegment")
    rows = customers.selectExpr(
        "c_custkey AS doc_id", f"posexplode({texts}) AS (p, t)"
    )
    return rows.selectExpr(
        "doc_id", "p + 1 AS page_no",
        "CASE WHEN p = 0 THEN replace(t, 'Taluka', 'TTTTaaaalllluuuukkkkaaaa') ELSE t END AS text",
    )
