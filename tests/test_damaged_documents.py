"""Damaged JSON documents are rows with an error; the sound ones beside them are read."""

import json

from rollweave.sources import readers

BAD = {"cut.json": '{"sources": [{"source_id"', "empty.json": "", "other.json": '{"x": 1}', "typed.json": '{"sources": 7, "state_id": "", "forms": []}'}


def written(tmp_path, good):
    for name, text in {**BAD, **{f"good{k}.json": json.dumps(g) for k, g in enumerate(good)}}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def told(errors):
    return {r.file.rsplit("/", 1)[1]: r.error for r in errors.collect()}


def test_manifests(spark, tmp_path):
    entry = {"source_id": "s", "state_id": "IN-MH", "roll_year": 2002, "source_label": "first"}
    good = [{"sources": [entry, {**entry, "source_id": "t"}]}, {"sources": [{**entry, "source_label": "later"}]}, {"sources": []}]
    entries, errors = readers.read_checked_manifests(spark, written(tmp_path, good))
    assert {(r.source_id, r.source_label) for r in entries.collect()} == {("s", "later"), ("t", "first")}
    found = told(errors)
    assert found == {"cut.json": "document is not valid JSON", "other.json": "sources is missing or not a list",
                     "typed.json": "sources is missing or not a list"} | ({"empty.json": found["empty.json"]} if "empty.json" in found else {})


def test_states(spark, tmp_path):
    good = [{"state_id": "IN-A", "name": "old", "sir_schedule": {"claims_end": "2026-09-04"}}, {"state_id": "IN-A", "name": "new", "sir_schedule": {"claims_end": ""}},
            {"state_id": "IN-B", "name": 5, "base_roll_years": "none"}]
    states, errors = readers.read_checked_states(spark, written(tmp_path, good))
    assert {(r.state_id, r["name"], r.sir_schedule.claims_end) for r in states.collect()} == {("IN-A", "new", None)}
    found = told(errors)
    assert found["good2.json"] == "document has fields of other types" and found["other.json"] == "state_id is missing"
    assert found["typed.json"] == "state_id is missing" and found["cut.json"] == "document is not valid JSON"


def test_forms(spark, tmp_path):
    good = [{"forms": {"form_6": {"label": "Form 6", "purpose": "p", "official_portal": "u"}}, "common_documents": {"age": ["a", "b"]}}]
    forms, kinds, errors = readers.read_checked_forms(spark, written(tmp_path, good))
    assert [(r.form_id, r.label) for r in forms.collect()] == [("form_6", "Form 6")]
    assert [(r.category, r.documents) for r in kinds.collect()] == [("age", ["a", "b"])]
    assert {"cut.json", "other.json", "typed.json"} <= set(told(errors)) and "good0.json" not in told(errors)
