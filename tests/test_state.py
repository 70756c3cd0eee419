"""Search, limiter, linkage, store and stream against brute force on small tables."""

import random

from pyspark.sql import functions as F

from rollweave import schemas
from rollweave.operators import crossroll, limiter, scan, search
from rollweave.sources import readers, writers
from rollweave.sources.load import RollTables
from rollweave.streaming.jobs import rate_limit_stream
from test_text import plain_trigrams


def test_batch_search_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    voters = [(i, rng.choice("xy"), rng.choice([None, i % 7]), f"{word()} {word()}") for i in range(300)]
    voters += [(1000 + i, "x", i, "abc de") for i in range(60)]  # one name held by many
    asked = [(i, rng.choice("xy"), f"{word()} {word()}") for i in range(40)] + [(99, "x", "ABC  de")]
    v = spark.createDataFrame(voters, "voter_record_id int, ac string, serial_number int, name_normalized string")
    q = spark.createDataFrame(asked, "query_id int, ac string, query string")
    for threshold, k in ((0.2, 5), (0.5, 3)):
        want = set()
        for qi, ac, text in asked:
            a = plain_trigrams(text)
            hits = []
            for vid, vac, serial, name in voters:
                b = plain_trigrams(name)
                score = len(a & b) / len(a | b)
                if vac == ac and score >= threshold - 1e-9:
                    hits.append((-score, serial is None, serial or 0, vid))
            want |= {(qi, rank, h[3]) for rank, h in enumerate(sorted(hits)[:k], 1)}
        got = search.fuzzy_search_batch(q, v, k, threshold, scope=("ac",))
        assert {(r["query_id"], r["rank"], r["voter_record_id"]) for r in got.collect()} == want


def test_limiter_small_case(spark):
    log = spark.createDataFrame([("c", t, i) for i, t in enumerate((100, 101, 102, 161))], "k string, t int, id int")
    log = log.withColumn("ts", F.timestamp_seconds("t"))
    got = limiter.rate_limit(log, "k", "ts", "id", 2, 60).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True]
    assert got[2]["retry_after_seconds"] == 58


def plain_limit(rows, most, window):
    logs, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        log = [x for x in logs.get(k, []) if x > t - window]
        ok = len(log) < most
        wait = 0 if ok else max(1, int(round(min(log) + window - t)))
        logs[k] = log + [t] if ok else log
        out[i] = (ok, most - len(logs[k]) if ok else 0, wait)
    return out


def busy_log(seed=2):
    rng, rows = random.Random(seed), []
    for key in range(5):
        t = 0
        for _ in range(500):
            t += rng.choice([0, 1, 2, 5, 40, 90, 300]) * (1 if key % 2 else 12)
            rows.append((key, t, len(rows)))
    return rows


def test_limiter_equals_plain_loop(spark):
    rows = busy_log()
    log = spark.createDataFrame(rows, "k int, t int, id int").withColumn("ts", F.timestamp_seconds("t"))
    for most, window in ((3, 60), (1, 10), (30, 600)):
        got = limiter.rate_limit(log, "k", "ts", "id", most, window).collect()
        assert {r["id"]: (r["allowed"], r["remaining"], r["retry_after_seconds"]) for r in got} == plain_limit(rows, most, window)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(busy_log(7), key=lambda r: r[1])
    schema = "k int, t int, id int"
    for part in range(4):
        chunk = rows[part * 625:(part + 1) * 625]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # File names do not order by time, so the stream takes all files in one batch.
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    query = (rate_limit_stream(stream, "k", "ts", "id", 3, 60).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["id"]: (r["allowed"], r["remaining"], r["retry_after_seconds"]) for r in got} == plain_limit(rows, 3, 60)


def test_linkage_equals_union_find(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 120), rng.choice([None, rng.randint(0, 200)])) for i in range(200)]
    parent = list(range(200))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at in (1, 2):
        seen = {}
        for r in rows:
            if r[at] is not None:
                a, b = root(r[0]), root(seen.setdefault(r[at], r[0]))
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = {r["id"]: r["canonical_id"] for r in crossroll.link_persons(df, "id", ["a", "b"]).collect()}
    assert got == {i: root(i) for i in range(200)}


STATE_ROW = "state_id string, eci_state_code string, name string, default_language string, data_capability string, public_launch_ready boolean"


def test_upserts_keep_created_at(spark, tmp_path):
    tables = RollTables(spark, str(tmp_path / "t"), slices=4)
    row = lambda n: spark.createDataFrame(
        [(f"S{i}", f"E{i}", n, "mr", "guidance_only", False) for i in range(6)], STATE_ROW)
    assert tables.upsert("states", row("first")) == 6
    before = {r["state_id"]: r["created_at"] for r in tables.table("states").collect()}
    assert tables.upsert("states", row("second").where("state_id < 'S3'")) == 3
    after = tables.table("states").collect()
    assert {r["state_id"]: r["created_at"] for r in after} == before and None not in before.values()
    assert sorted(r["name"] for r in after) == ["first"] * 3 + ["second"] * 3
    assert tables.upsert("states", row("x").where("false")) == 0 and tables.table("states").count() == 6
    assert tables.table("voter_records").columns == [c.split()[0] for c in schemas.TABLES["voter_records"].split(", ")]


def test_load_with_state_gate_is_done_once(spark, tmp_path):
    from rollweave.plans import extraction
    from rollweave.session import stage

    folder = "/root/testdata/sf0.001"
    tables = RollTables(spark, str(tmp_path / "t"), slices=4)
    people = stage(extraction.voters(spark, folder), "voters")
    documents = extraction.documents(spark, folder)
    none = {r["table"]: r["row_count"] for r in tables.load(0, documents, people, "salt").collect()}
    assert set(none) == set(schemas.LOAD_ORDER) and set(none.values()) == {0}
    assert tables.rejected().count() == documents.count()

    tables.upsert("states", spark.createDataFrame([(f"ST-{i}", f"E{i}", "n", "mr", "guidance_only", False) for i in range(3)], STATE_ROW))
    counts = {r["table"]: r["row_count"] for r in tables.load(1, documents, people, "salt").collect()}
    rows = {t: sorted(map(str, tables.table(t).collect())) for t in schemas.LOAD_ORDER}
    assert {t: len(r) for t, r in rows.items()} == counts and counts["voter_records"] > 0
    for number in (1, 2):  # the same batch again, and the same rows as another batch
        tables.load(number, documents, people, "salt")
        again = {t: tables.table(t) for t in schemas.LOAD_ORDER}
        for t, r in rows.items():
            assert len(r) == again[t].count()
            if t != "extraction_runs" or number == 1:  # a run's finishing time is the last one
                assert sorted(map(str, again[t].collect())) == r
    assert tables.loads().count() == 3 * len(schemas.LOAD_ORDER)


def test_redaction_and_substring(spark):
    rows = [("IN-MH", 172, 1, 5, "Sample Person", 2002, "k", "ok", "l", 0.9, "1234"),
            ("IN-MH", 173, 1, 6, "Demo Person", 2002, "k", "ok", "l", 0.9, None)]
    df = spark.createDataFrame(rows, schemas.SEARCH_RECORD)
    got = search.substring_search(df, "IN-MH", 172, "sample").collect()
    assert len(got) == 1 and got[0]["epic_hint"] == "***1234" and "epic_last4" not in got[0].asDict()
    assert search.substring_search(df, "IN-MH", 172, "demo").isEmpty()


def test_scan_files_and_checksums(spark, tmp_path):
    secret = "AKIA" + "A" * 16
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_bytes(f"fine\r\nkey {secret} token: x\n".encode())
    (tmp_path / "docs" / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "docs" / "c.bin").write_bytes(b"ab\0cd")
    (tmp_path / "docs" / "d.pem").write_bytes(b"x")
    files = readers.read_file_texts(spark, str(tmp_path))
    got = {(r["path"], r["label"], r["line_no"]) for r in scan.scan_files(files).collect()}
    assert got == {("docs/a.md", "aws access key", 2), ("docs/a.md", "inline secret assignment", 2),
                   ("docs/b.txt", "non-utf8 text candidate", None), ("docs/c.bin", "binary candidate", None),
                   ("docs/d.pem", "blocked path", None)}
    import hashlib
    sums = {r["path"].rsplit("/", 1)[1]: r["checksum"] for r in readers.checksums(spark, str(tmp_path)).collect()}
    assert sums["d.pem"] == "sha256:" + hashlib.sha256(b"x").hexdigest()


def test_registry_readers(spark, tmp_path):
    import json
    entry = {"source_id": "a", "state_id": "S", "roll_year": 2002, "roll_kind": "base_roll", "source_label": "old", "source_uri": "u"}
    (tmp_path / "m.json").write_text(json.dumps({"sources": [entry, {**entry, "source_label": "new", "reviewed": True}]}, indent=1))
    got = readers.read_manifests(spark, str(tmp_path / "m.json")).collect()
    assert len(got) == 1 and got[0]["source_label"] == "new" and got[0]["reviewed"] and got[0]["checksum"] == ""
    (tmp_path / "f.json").write_text(json.dumps({
        "forms": {"form_8": {"label": "8", "purpose": "p", "official_portal": "o"}, "form_6": {"label": "6", "purpose": "p", "official_portal": "o"}},
        "common_documents": {"identity": ["x"]}}, indent=1))
    forms, kinds = readers.read_forms(spark, str(tmp_path / "f.json"))
    assert [r["form_id"] for r in forms.collect()] == ["form_6", "form_8"] and kinds.first()["documents"] == ["x"]


def test_exports(spark, tmp_path):
    rows = [(1, "¶ÉäJÉ", "", 46, 21, 2002, "ok")]
    df = spark.createDataFrame(rows, "serial_number int, voter_name string, relative_name string, ac_number int, part_number int, year int, data_quality string")
    writers.export_csv(df, str(tmp_path / "csv"))
    writers.export_json(df, str(tmp_path / "json"))
    writers.export_enriched(df, str(tmp_path / "en"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.first()["file"] == "ac046_part021_2002" and back.first()["data_quality"] == "ok"
    assert spark.read.json(str(tmp_path / "en")).first()["voter_name_en"] == "shekha"


def test_search_refuses_bad_requests(spark):
    import pytest
    empty = spark.createDataFrame([], "state_id string")
    bad = [("", 172, "name", 10, 0.2), ("S", 0, "name", 10, 0.2), ("S", 1, " a ", 10, 0.2), ("S", 1, "name", 21, 0.2), ("S", 1, "name", 5, 1.5)]
    for state, ac, query, limit, threshold in bad:
        with pytest.raises(ValueError):
            search.fuzzy_search(empty, empty, empty, state, ac, query, limit, threshold)


def test_single_search_report(spark):
    v = spark.createDataFrame(
        [(1, "S", "a", "p", None, "Sample Person", "sample person", 30, "F", "father", "ok", "1234"),
         (2, "S", "a", "q", 7, "Sample Person", "sample person", 31, "M", "father", "ok", "9999"),
         (3, "S", "b", "p", 1, "Sample Person", "sample person", 31, "M", "father", "ok", "9999")],
        "voter_record_id int, state_id string, ac_id string, polling_station_id string, serial_number int, name_original string, "
        "name_normalized string, age int, gender string, relation_type string, data_quality string, epic_last4 string")
    acs = spark.createDataFrame([("a", 172), ("b", 173)], "ac_id string, ac_number int")
    ps = spark.createDataFrame([("p", 4)], "polling_station_id string, part_number int")
    hits = search.fuzzy_search(v, acs, ps, "S", 172, "Sampel person")
    rows = hits.collect()
    # The record without a serial stands last, the one without a known station keeps a NULL part.
    assert [(r["serial_number"], r["part_number"]) for r in rows] == [(7, None), (None, 4)]
    assert "epic_last4" not in hits.columns
    report = search.search_report(hits, "S", 172, "Sampel person", 10, 0.2).first()
    assert report["result_count"] == 2 and report["query_summary"] == "len:13 prefix:sa"
    assert [r["serial_number"] for r in report["results"]] == [7, None]
