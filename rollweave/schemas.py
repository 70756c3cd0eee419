"""Schemas of the tables and registries."""

from __future__ import annotations

PAGE_TEXT = "doc_id string, page_no int, text string"


MANIFEST_FIELDS = (
    "source_id string, state_id string, roll_year int, roll_kind string, source_label string, "
    "source_uri string, local_path string, parser_hint string, language string, checksum string, "
    "reviewed boolean, notes string"
)
MANIFEST_DOCUMENT = f"sources array<struct<{MANIFEST_FIELDS.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>"

_SCHEDULE = (
    "phase:string, qualifying_date:string, enumeration_start:string, enumeration_end:string, "
    "draft_roll_date:string, claims_start:string, claims_end:string, final_roll_date:string, status:string"
)
SCHEDULE_DATES = (
    "qualifying_date", "enumeration_start", "enumeration_end", "draft_roll_date",
    "claims_start", "claims_end", "final_roll_date",
)
STATE_DOCUMENT = (
    "state_id string, eci_state_code string, name string, short_name string, "
    "languages array<string>, scripts array<string>, default_language string, "
    f"sir_schedule struct<{_SCHEDULE}>, "
    "schedule_provenance struct<label:string, source_type:string, confidence:string, notes:string>, "
    "ceo_portal string, "
    "official_sources array<struct<label:string, url:string, source_type:string, last_verified:string, notes:string>>, "
    "base_roll_years array<int>, historical_source_shape string, current_roll_source_shape string, "
    "data_capability string, parser_status string, public_launch_ready boolean, privacy_notes string"
)
FORMS_DOCUMENT = (
    "forms map<string, struct<label:string, purpose:string, official_portal:string>>, "
    "common_documents map<string, array<string>>"
)
SEARCH_RECORD = (
    "state_id string, ac_number int, part_number int, serial_number int, name string, roll_year int, "
    "roll_kind string, data_quality string, source_label string, confidence double, epic_last4 string"
)

# The nine relational tables: column list, key and the columns other tables refer to.
TABLES = {
    "states": "state_id string, eci_state_code string, name string, default_language string, "
              "data_capability string, public_launch_ready boolean, created_at timestamp",
    "districts": "district_id string, state_id string, eci_district_code string, name string",
    "assembly_constituencies": "ac_id string, state_id string, district_id string, ac_number int, "
                               "name string, reservation_status string",
    "polling_stations": "polling_station_id string, ac_id string, part_number int, name string, "
                        "address_redacted string, source_updated_at date",
    "roll_versions": "roll_version_id string, state_id string, roll_year int, roll_kind string, "
                     "language string, source_label string, source_url string, published_on date, "
                     "created_at timestamp",
    "voter_records": "voter_record_id string, roll_version_id string, state_id string, ac_id string, "
                     "polling_station_id string, serial_number int, name_original string, "
                     "name_normalized string, name_phonetic string, relation_type string, "
                     "relative_name_normalized string, age int, gender string, epic_hash string, "
                     "epic_last4 string, data_quality string, source_confidence decimal(4,3), "
                     "created_at timestamp",
    "source_documents": "source_document_id string, state_id string, roll_version_id string, "
                        "source_uri string, local_path string, checksum string, parser_hint string, "
                        "status string, created_at timestamp",
    "extraction_runs": "extraction_run_id string, source_document_id string, parser_name string, "
                       "expected_records int, parsed_records int, quality_summary string, status string, "
                       "started_at timestamp, finished_at timestamp",
    "guidance_rules": "rule_id string, state_id string, situation string, priority string, "
                      "action_template string, source_labels array<string>",
}
KEYS = {
    "states": "state_id",
    "districts": "district_id",
    "assembly_constituencies": "ac_id",
    "polling_stations": "polling_station_id",
    "roll_versions": "roll_version_id",
    "voter_records": "voter_record_id",
    "source_documents": "source_document_id",
    "extraction_runs": "extraction_run_id",
    "guidance_rules": "rule_id",
}
UNIQUE = {
    "states": ["eci_state_code"],
    "assembly_constituencies": ["state_id", "ac_number"],
    "polling_stations": ["ac_id", "part_number"],
}
# child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("districts", "state_id", "states", "state_id"),
    ("assembly_constituencies", "state_id", "states", "state_id"),
    ("assembly_constituencies", "district_id", "districts", "district_id"),
    ("polling_stations", "ac_id", "assembly_constituencies", "ac_id"),
    ("roll_versions", "state_id", "states", "state_id"),
    ("voter_records", "roll_version_id", "roll_versions", "roll_version_id"),
    ("voter_records", "state_id", "states", "state_id"),
    ("voter_records", "ac_id", "assembly_constituencies", "ac_id"),
    ("voter_records", "polling_station_id", "polling_stations", "polling_station_id"),
    ("source_documents", "state_id", "states", "state_id"),
    ("source_documents", "roll_version_id", "roll_versions", "roll_version_id"),
    ("extraction_runs", "source_document_id", "source_documents", "source_document_id"),
    ("guidance_rules", "state_id", "states", "state_id"),
)
# Order in which a load writes its tables, parents first.
LOAD_ORDER = (
    "assembly_constituencies", "polling_stations", "roll_versions",
    "source_documents", "extraction_runs", "voter_records",
)
