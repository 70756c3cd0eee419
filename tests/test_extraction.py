"""Line extraction against a plain-Python reading of the same rules, on generated lines."""

import random
import re

from pyspark.sql import functions as F

from rollweave.functions.layout import ANCHOR, HEAD
from rollweave.operators import cover, ingest, lines

GLYPHS = ["+É", "¤É", "¶ÉäJÉ", "{ÉÉ]õÒ±É"]


def made_lines(n=400, seed=5):
    rng = random.Random(seed)
    for _ in range(n):
        name = " ".join(rng.sample(GLYPHS, rng.randint(0, 2)))
        mark = rng.choice([" {É ", " ´É ", " ", "  "])
        age = rng.choice(["34", "0", "-1", "5", "259", "17", "131", "130", "-2", "99999", "x"])
        ident = rng.choice(["", " MT/07/046/0000123", " MT/07/046/000 360", " MT/07/046/1234 5678", " MT/07/046/203ÚÆ", " junk"])
        head = rng.choice(["12 H1 ", "9999  B/2 ", "12345 H ", "x 1 ", "7 ", ""])
        yield f"{head}{name}{mark}{rng.choice(GLYPHS)} {rng.choice(['{ÉÖ', 'ºjÉÒ', 'xx'])} {age}{ident}".strip()


def expected(line):
    tail, head = re.search(ANCHOR, line), re.match(HEAD, line)
    if not tail or not head:
        return None
    middle = line[head.end():max(head.end(), tail.start())].strip()
    before, mark, after = (re.split(r"\s(\{É|´É)\s", middle, maxsplit=1) + [None, None])[:3]
    years = int(tail[2])
    age = years if -1 <= years <= 130 else None
    rest = line[tail.start():]
    whole = re.search(r"MT/\d{2}/\d{3}/\d{7}", rest)
    split = re.search(r"(MT/\d{2}/\d{3}/)(\d{3,4})\s+(\d{1,4})", rest)
    ident = whole[0] if whole else split[1] + (split[2] + split[3]).zfill(7) if split else ""
    flags = [] if before.strip() else ["truncated_line"]
    if age is None:
        flags.append("corrupt_age")
    elif age in (0, -1):
        flags.append("missing_age")
    elif age < 17:
        flags.append("underage")
    return (int(head[1]), head[2], before.strip(), {"{É": "husband", "´É": "father", None: "unknown"}[mark],
            (after or "").strip(), "M" if tail[1] == "{ÉÖ" else "F", age, ident, ",".join(flags) or "ok")


FIELDS = ["serial_number", "house_number", "voter_name", "relation_type", "relative_name", "gender", "age",
          "epic_number", "data_quality"]


def test_lines_like_plain_python(spark):
    made = list(made_lines()) + [
        "12 H001 +É {É ¤É {ÉÖ 34", "13 H002 +É ´É ¤É ºjÉÒ 0", "491 ´É {ÉÖ 1", "12 {ÉÖ 34", "7 A B ºjÉÒ 259 MT/00/000/000 360"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(made)], "i int, line string")
    got = {r["i"]: tuple(r[f] for f in FIELDS) for r in lines.extract_records(df).collect()}
    want = {i: expected(l) for i, l in enumerate(made) if expected(l)}
    assert got == want and len(want) > 50
    assert got[len(made) - 1][7:] == ("MT/00/000/0000360", "corrupt_age")


def page_rows():
    bold = lambda s: "".join(ch * 4 for ch in s)
    voter = lambda n: f"{n} H {GLYPHS[n % 4]} {{É +É {{ÉÖ 40"
    rows = [("d", 1, "cover\n" + voter(1)), ("d", 2, "\n".join([voter(1), "3 " + bold("Ward"), voter(2)]))]
    # Enough pages for several blocks: the section of page 2 must reach the last ones.
    rows += [("d", p, voter(p)) for p in range(3, 200)]
    rows += [("d", 200, "4 " + bold("Hill") + "\n" + voter(2) + "\n" + voter(500)), ("d", 201, voter(999))]
    return rows


def test_sections_cross_blocks_and_first_serial_wins(spark):
    pages = spark.createDataFrame(page_rows(), "doc_id string, page_no int, text string")
    got = {r["serial_number"]: (r["page_no"], r["section_number"], r["section_name"])
           for r in lines.extract_voters(lines.page_lines(pages)).collect()}
    assert got[1] == (2, 0, "") and got[2] == (2, 3, "Ward")
    assert got[199] == (199, 3, "Ward") and got[500] == (200, 4, "Hill")
    assert 999 not in got and len(got) == 200
    counted = pages.withColumn("page_count", F.lit(201))
    assert lines.extract_voters(lines.page_lines(counted)).count() == 200
    heads = lines.section_map(lines.section_headers(lines.page_lines(pages))).first()
    assert heads["sections"] == {3: "Ward", 4: "Hill"}


def test_cover_count_order(spark):
    rows = [
        ("1 120 60 60 120", "1 999 400 599 999", (1, 120, 60, 60, 120)),
        ("1 120 60 61 120", "1 999 400 599 999", (1, 999, 400, 599, 999)),
        ("60 70 130", "55 65 120", (0, 0, 55, 65, 120)),
        ("60 70 130", "none", (0, 0, 60, 70, 130)),
        ("10 10 20", "none", (0, 0, 0, 0, 0)),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    got = [tuple(r[0]) for r in df.select(cover.count_block(F.col("a"), F.col("b"))).collect()]
    assert got == [c for _, _, c in rows]


def parsed(spark, total=0, checksum="sha256:" + "a" * 64):
    doc = [("d", "IN-MH", 2002, 172, 21, total, "", "", "School", checksum, "local://x")]
    docs = spark.createDataFrame(
        doc, "doc_id string, state_id string, revision_year int, ac_number int, part_number int, total_voters int, "
             "ac_name_encoded string, ac_reservation_encoded string, polling_station_name_encoded string, checksum string, source_uri string")
    people = spark.createDataFrame(
        [("d", 1, "  Sample   Voter  ", "father", "R", 41, "M", "sample-card-0001", "ok"),
         ("d", 2, "Second Voter", "spouse", "", 39, "F", "sample-card-0002", "missing_age,review")],
        "doc_id string, serial_number int, voter_name string, relation_type string, relative_name string, age int, "
        "gender string, epic_number string, data_quality string")
    return docs, people


def test_batch_rows(spark):
    docs, people = parsed(spark)
    accepted, rejected = ingest.split_reconciled(ingest.reconcile(docs, people))
    assert rejected.isEmpty()
    batch = ingest.fan_out(accepted, people, "salt")
    voters = batch["voter_records"].orderBy("serial_number").collect()
    assert [v["name_normalized"] for v in voters] == ["sample voter", "second voter"]
    assert [v["epic_last4"] for v in voters] == ["0001", "0002"]
    run = batch["extraction_runs"].first()
    assert run["quality_summary"] == '{"missing_age":1,"ok":1,"review":1}' and run["expected_records"] == 2
    assert batch["assembly_constituencies"].first()["name"] == "AC 172"
    shown = " ".join(str(r) for name in batch for r in batch[name].drop("name_original").collect())
    assert "sample-card" not in shown and "salt" not in shown
    import pytest
    with pytest.raises(ValueError):
        ingest.fan_out(accepted, people, "")


def test_rejected_documents(spark):
    docs, people = parsed(spark, total=3)
    _, bad = ingest.split_reconciled(ingest.reconcile(docs, people))
    assert bad.first()["blockers"] == ["parsed record count mismatch: expected 3, got 2"]
    docs, people = parsed(spark, checksum="")
    _, bad = ingest.split_reconciled(ingest.reconcile(docs, people))
    assert bad.first()["blockers"] == ["source document checksum is required before ingestion"]
