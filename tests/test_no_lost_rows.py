"""Cases in which rows could vanish without a word."""

import pytest

from rollweave.operators import guidance, limiter, readiness, scan, upsert
from rollweave.plans import registries
from rollweave.sources import load, readers, writers

STATE = "state_id string, eci_state_code string, name string, default_language string, data_capability string, public_launch_ready boolean"


def states(spark, ids, name="n"):
    return spark.createDataFrame([(f"S{i}", f"E{i}", name, "mr", "guidance_only", False) for i in ids], STATE)


def test_store_opened_with_another_number_of_slices(spark, tmp_path):
    load.RollTables(spark, str(tmp_path / "t"), slices=4).upsert("states", states(spark, range(20)))
    for i in range(4):
        load.RollTables(spark, str(tmp_path / "t"), slices=8).upsert("states", states(spark, [i], "new"))
    rows = load.RollTables(spark, str(tmp_path / "t")).table("states").collect()
    assert sorted(r.state_id for r in rows) == sorted(f"S{i}" for i in range(20))
    assert {r.state_id for r in rows if r.name == "new"} == {"S0", "S1", "S2", "S3"}


def test_exports_leave_other_folders(spark, tmp_path):
    row = lambda ac: spark.createDataFrame([(ac, 1, 2002, "x")], "ac_number int, part_number int, year int, voter_name string")
    for ac in (46, 47, 47):
        writers.export_json(row(ac), str(tmp_path / "records"))
        writers.export_documents(row(ac), str(tmp_path / "documents"))
        writers.export_csv(row(ac).selectExpr("*", "'ok' AS data_quality"), str(tmp_path / "csv"))
    for folder in ("records", "documents"):
        assert sorted(r.ac_number for r in spark.read.json(str(tmp_path / folder)).collect()) == [46, 47]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_anchored_patterns_hit_single_lines(spark):
    texts = spark.createDataFrame([(1, "first\nBEGIN here\nlast"), (2, "no BEGIN"), (3, None)], "path long, text string")
    found = lambda p: [(r.path, r.line_no) for r in scan.sensitive_scan(texts, patterns=[("x", p, False)]).collect()]
    assert found("^BEGIN") == [(1, 2)]
    assert found("here$") == [(1, 2)]
    assert found("(?<!no )BEGIN") == [(1, 2)]
    assert found("BEGIN") == [(1, 2), (2, 1)]


def test_limiter_decides_every_request(spark):
    at = "2024-01-01 00:00:0"
    log = spark.createDataFrame([(1, at + "1", 1), (None, at + "1", 2), (None, at + "2", 3), (None, at + "3", 4), (1, None, 5)],
                                "k long, ts string, id long").selectExpr("k", "CAST(ts AS timestamp) AS ts", "id")
    got = {r.id: (r.allowed, r.remaining) for r in limiter.rate_limit(log, "k", "ts", "id", 2, 60).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 0), 4: (False, 0), 5: (False, 0)}


def test_append_rejects_repeats_within_the_new_rows(spark):
    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), ("c", 5)], "id string, v int")
    merged, rejected = upsert.append_new(old, new, "id")
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1), ("b", 3), ("c", 5)]
    assert sorted((r.id, r.v) for r in rejected.collect()) == [("a", 2), ("b", 4)]
    assert all("already exists" in r.error for r in rejected.collect())


def test_seeding_needs_known_states(spark):
    target = states(spark, []).selectExpr("*")
    assert upsert.seed_states(target, states(spark, [1, 2]), "S1").count() == 1
    for registry, wanted in ((states(spark, []), None), (states(spark, [1]), "S9")):
        with pytest.raises(ValueError):
            upsert.seed_states(target, registry, wanted)


def test_manifests_without_sources_are_reported(spark):
    docs = spark.createDataFrame([("f1", None), ("f2", [("s1",)])], "file string, sources array<struct<source_id: string>>")
    assert [(r.file, "missing" in r.error) for r in readers.malformed_manifests(docs).collect()] == [("f1", True)]



def test_quality_named_unknown_beside_missing_quality(spark):
    voters = spark.createDataFrame([("s", "a", None, q) for q in (None, "unknown", "ok", "underage")], "state_id string, ac_id string, polling_station_id string, data_quality string")
    acs = spark.createDataFrame([("a", 7)], "ac_id string, ac_number int")
    stations = spark.createDataFrame([], "polling_station_id string, part_number int")
    row = readiness.scope_counts(voters, acs, stations).first()
    assert row.quality_summary == {"ok": 1, "underage": 1, "unknown": 2}
    assert (row.voter_records, row.ok_records, row.issue_records) == (4, 1, 2)


def test_cards_of_blocked_requests_carry_the_message(spark):
    folder = "/root/testdata/sf0.001"
    asked, known = registries.request_rows(spark, folder), registries.registry_rows(spark, folder)
    odd = asked.limit(1).selectExpr("-1 AS request_id", "CAST(NULL AS STRING) AS state_id", *asked.columns[2:])
    asked = asked.unionByName(odd).cache()
    cards = {r.request_id: r.error for r in guidance.guidance_cards(asked, known, *registries.forms_rows(spark, folder)).collect()}
    answers = {r.request_id: r.error for r in guidance.guidance(asked, known).collect()}
    states_known = {r.state_id for r in known.collect()}
    want = {r.request_id: f"unknown state_id: {r.state_id or ''}" if r.state_id not in states_known
            else "unsupported situation: lost" if r.situation == "lost" else None for r in asked.collect()}
    assert cards == answers == want
    assert {None, "unsupported situation: lost", "unknown state_id: "} <= set(want.values())
