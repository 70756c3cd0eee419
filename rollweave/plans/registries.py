"""Rule sets, registries and guidance over rows made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.operators import guidance, manifests, registry, requests
from rollweave.operators import guidance_text as words
from rollweave.plans import Catalog, table
from rollweave.sources import readers

# -- source manifests from parts ----------------------------------------------------------
_HEX = "repeat(substr('0123456789abcdef', CAST(p_partkey % 16 AS INT) + 1, 1), 64)"
MANIFEST = {
    "source_id": "concat('src-', p_partkey)",
    "state_id": "concat('ST-', p_size)",
    "roll_year": "CAST(CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 2002 END AS INT)",
    "roll_kind": "'base_roll'",
    "source_label": "CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END",
    "source_uri": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('https://rolls.example/', p_partkey) END",
    "local_path": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('/abs/', p_partkey) WHEN 2 THEN concat('other/', p_partkey) WHEN 3 THEN concat('samples/', p_partkey, '.pdf') ELSE concat('data/', p_partkey, '.pdf') END",
    "parser_hint": "CASE WHEN p_partkey % 13 = 0 THEN 'other' ELSE 'parse_2002' END",
    "language": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'mr' END",
    "checksum": f"CASE WHEN p_partkey % 9 = 0 THEN 'sha256:xyz' ELSE concat('sha256:', {_HEX}) END",
    "reviewed": "p_partkey % 3 <> 0",
    "notes": "p_type",
}
MANIFEST_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in MANIFEST.items()) + " FROM part"
# A file for most paths; some differ from the manifest.
FILES = {
    "path": "concat(CASE WHEN p_partkey % 29 = 0 THEN 'gone/' ELSE 'data/' END, p_partkey, '.pdf')",
    "checksum": f"concat('sha256:', CASE WHEN p_partkey % 5 = 0 THEN repeat('f', 64) ELSE {_HEX} END)",
}
FILES_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in FILES.items()) + " FROM part"


def _select(df, spec: dict[str, str]):
    return df.selectExpr(*[f"{v} AS {k}" for k, v in spec.items()])


def manifest_rows(spark, folder):
    return _select(table(spark, folder, "part"), MANIFEST)


def file_rows(spark, folder):
    return _select(table(spark, folder, "part"), FILES)


def _list(*cases: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in cases) + "], lambda x: x IS NOT NULL)"


def _t(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OUT = "split_part(local_path, '/', 1) NOT IN ('data', 'samples')"
FIELD_RULES = (
    ("NOT reviewed", _t("source manifest entry must be reviewed before ingestion")),
    ("roll_year <= 0", _t("roll_year must be positive")),
    ("source_label = ''", _t("source_label is required")),
    ("source_uri = ''", _t("source_uri is required")),
    ("NOT regexp_matches(checksum, '^sha256:[0-9a-f]{64}$')", _t("checksum must be sha256:<64 lowercase hex>")),
    ("local_path IS NULL", _t("local_path is required for local ingestion")),
    ("local_path LIKE '/%'", _t("local_path must be repo-relative")),
    (f"local_path NOT LIKE '/%' AND {_OUT}", _t("local_path must stay under ignored data/ or samples/ directories")),
    ("parser_hint <> 'parse_2002'", _t("parser_hint must be parse_2002 for the current local pipeline")),
    ("language IS NULL", _t("language is required")),
)
FILE_RULES = (
    ("local_path IS NULL", _t("local_path is required for checksum verification")),
    ("local_path IS NOT NULL AND actual IS NULL", _t("local_path file does not exist for checksum verification")),
    ("actual <> checksum", _t("local file checksum does not match source manifest")),
)
_JOINED = f"""WITH mf AS ({MANIFEST_SQL}), files AS ({FILES_SQL}),
    j AS (SELECT mf.*, files.checksum AS actual FROM mf LEFT JOIN files ON mf.local_path = files.path)"""

# -- state registry from suppliers --------------------------------------------------------
_DAY = "CAST(DATE '2026-01-01' + CAST(s_suppkey % {0} AS INT) AS DATE)"
_OPT = "CASE WHEN s_suppkey % {1} = 0 THEN NULL ELSE " + _DAY + " END"
REGISTRY = {
    "state_id": "concat('ST-', s_suppkey)",
    "name": "s_name",
    "languages": "CASE s_suppkey % 3 WHEN 0 THEN 'en,hi,mr' WHEN 1 THEN 'en,bn,xx' ELSE 'en' END",
    "capability": "CASE s_suppkey % 6 WHEN 0 THEN 'guidance_only' WHEN 1 THEN 'official_link_search' WHEN 2 THEN 'pilot_indexed_search' WHEN 3 THEN 'wrong_value' ELSE 'validated_indexed_search' END",
    "status": "CASE s_suppkey % 3 WHEN 0 THEN 'enumeration_scheduled' WHEN 1 THEN 'final_roll_published' ELSE 'claims_open_now' END",
    "enumeration_end": _OPT.format(200, 4),
    "claims_end": _OPT.format(230, 3),
    "final_roll_date": _OPT.format(270, 10),
    "label": "CASE WHEN s_suppkey % 8 = 0 THEN 'Unlisted' ELSE 'Report' END",
    "source_type": "CASE WHEN s_suppkey % 5 < 3 THEN 'official_portal' ELSE 'public_report' END",
    "confidence": "CASE s_suppkey % 7 WHEN 0 THEN 'reported' WHEN 1 THEN 'rumour' ELSE 'official' END",
    "first_type": "CASE WHEN s_suppkey % 10 < 5 THEN 'official_portal' ELSE 'public_report' END",
    "checked": _OPT.format(90, 12),
    "ready": "s_suppkey % 4 <> 1",
    "portal": "concat('https://ceo.example/', s_suppkey % 40)",
}
REGISTRY_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in REGISTRY.items()) + " FROM supplier"


def registry_rows(spark, folder):
    """Suppliers as state documents, read through the registry's own typing."""
    c = F.col
    flat = _select(table(spark, folder, "supplier"), REGISTRY)
    text = lambda name: c(name).cast("string")
    none = F.lit(None).cast("string")
    source = lambda label, url, kind: F.struct(
        label.alias("label"), url.alias("url"), kind.alias("source_type"),
        text("checked").alias("last_verified"), none.alias("notes"))
    documents = flat.select(
        "state_id", F.lit("E1").alias("eci_state_code"), "name", c("name").alias("short_name"),
        F.split("languages", ",").alias("languages"), F.array(F.lit("Latin")).alias("scripts"),
        F.lit("mr").alias("default_language"),
        F.struct(
            F.lit("Phase").alias("phase"), F.lit("").alias("qualifying_date"), none.alias("enumeration_start"),
            text("enumeration_end").alias("enumeration_end"), none.alias("draft_roll_date"),
            none.alias("claims_start"), text("claims_end").alias("claims_end"),
            text("final_roll_date").alias("final_roll_date"), "status",
        ).alias("sir_schedule"),
        F.struct("label", "source_type", "confidence", F.lit("note").alias("notes")).alias("schedule_provenance"),
        c("portal").alias("ceo_portal"),
        F.array(source(F.lit("Report"), c("portal"), c("first_type")),
                source(F.lit("Voters portal"), F.concat("portal", F.lit("/v")), F.lit("official_portal"))).alias("official_sources"),
        F.array(F.lit(2002)).alias("base_roll_years"), F.lit("a").alias("historical_source_shape"),
        F.lit("b").alias("current_roll_source_shape"), c("capability").alias("data_capability"),
        F.lit("p").alias("parser_status"), c("ready").alias("public_launch_ready"), F.lit("n").alias("privacy_notes"),
    )
    return readers.typed_states(documents)


def _day(c: str) -> str:
    return f"strftime({c}, '%-d %b %Y')"


# -- guidance requests from customers -----------------------------------------------------
_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(requests.SITUATIONS))
_ANSWER = "CASE ({0}) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END"
REQUEST = {
    "request_id": "c_custkey",
    "state_id": "concat('ST-', c_custkey % 130)",
    "situation": f"CASE c_custkey % 9 {_CASE} ELSE 'lost' END",
    "blo_visited": _ANSWER.format("c_custkey + c_nationkey"),
    "enumeration_form_received": _ANSWER.format("floor(c_custkey / 9)").replace("(floor(c_custkey / 9))", "CAST(floor(c_custkey / 9) AS BIGINT)"),
    "enumeration_form_submitted": _ANSWER.format("CAST(floor(c_custkey / 27) AS BIGINT)"),
    "current_roll_found": _ANSWER.format("CAST(floor(c_custkey / 81) AS BIGINT) + c_nationkey"),
    "base_roll_found": _ANSWER.format("c_custkey + 1"),
    "today": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(DATE '2026-01-01' + CAST(c_custkey % 220 AS INT) AS DATE) END",
}
REQUEST_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in REQUEST.items()) + " FROM customer"


def request_rows(spark, folder):
    return _select(table(spark, folder, "customer"), REQUEST)


# A forms catalogue made of the nations (forms) and regions (document categories).
FORM_IDS = {1: "form_6", 2: "form_7", 3: "form_8"}
KINDS = {0: "identity", 1: "address", 2: "age", 3: "correction", 4: "other"}


def _cases(key: str, table_: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table_.items()) + " END"


def forms_rows(spark, folder):
    form_id = _cases("n_nationkey", FORM_IDS).replace(" END", " ELSE concat('form_n', n_nationkey) END")
    forms = table(spark, folder, "nation").selectExpr(
        f"{form_id} AS form_id", "concat('Form ', n_name) AS label", "n_name AS purpose", "'https://p.example/' AS official_portal")
    kinds = table(spark, folder, "region").selectExpr(
        f"{_cases('r_regionkey', KINDS)} AS category", "array(r_name, concat('proof ', r_name)) AS documents")
    return forms, kinds


def _by_situation(edition: dict, at: int) -> str:
    """SQL CASE over the situation for one column of an edition."""
    def show(v):
        return "[" + ", ".join(_t(x) for x in v) + "]" if isinstance(v, list) else _t(v)
    return "CASE situation " + " ".join(f"WHEN '{s}' THEN {show(r[at])}" for s, r in edition.items()) + " END"


def register(catalog: Catalog) -> None:
    @catalog.add("manifest_scan", """
        WITH e AS (SELECT concat('src-', p_partkey % 1500) AS source_id, p_partkey AS pos, p_name, p_brand, p_partkey % 2 = 0 AS reviewed FROM part)
        SELECT source_id, arg_max(p_name, pos) AS source_label, arg_max(reviewed, pos) AS reviewed, '' AS checksum FROM e GROUP BY source_id""")
    def manifest_scan(spark, folder):
        entries = table(spark, folder, "part").selectExpr(
            "lpad(concat('', p_partkey), 12, '0') AS file",
            "array(named_struct('source_id', concat('src-', p_partkey % 1500), 'source_label', p_name, 'checksum', cast(NULL AS STRING), 'reviewed', p_partkey % 2 = 0, 'notes', cast(NULL AS STRING), 'local_path', '')) AS sources",
        )
        return readers.manifest_entries(entries).select("source_id", "source_label", "reviewed", "checksum")

    @catalog.add("manifest_rules", _JOINED + f"""
        , r AS (SELECT *, list_concat({_list(*FIELD_RULES)}, {_list(*FILE_RULES)}) AS b, len({_list(*FILE_RULES)}) = 0 AS checksum_verified FROM j)
        SELECT source_id, array_to_string(b, '; ') AS blockers, checksum_verified, len(b) = 0 AS valid_for_ingestion FROM r""")
    def manifest_rules(spark, folder):
        got = manifests.manifest_blockers(manifest_rows(spark, folder), file_rows(spark, folder))
        return got.select("source_id", F.array_join("blockers", "; ").alias("blockers"), "checksum_verified", "valid_for_ingestion")

    checks = [
        ("official_source_uri", "source_uri <> ''"), ("source_label", "source_label <> ''"),
        ("local_path", f"local_path IS NOT NULL AND local_path NOT LIKE '/%' AND NOT {_OUT}"),
        ("checksum", "regexp_matches(checksum, '^sha256:[0-9a-f]{64}$')"), ("checksum_verified", "verified"),
        ("parser_hint", "parser_hint = 'parse_2002'"), ("language", "language IS NOT NULL"), ("human_review", "reviewed"),
    ]
    listed = " || ';' || ".join(f"'{i}=' || CASE WHEN coalesce({c}, false) THEN 'true' ELSE 'false' END" for i, c in checks)

    @catalog.add("manifest_review", _JOINED + f"""
        , r AS (SELECT *, list_concat({_list(*FIELD_RULES[1:])}, {_list(*FILE_RULES)}) AS b, len({_list(*FILE_RULES)}) = 0 AS verified FROM j)
        SELECT source_id, array_to_string(b, '; ') AS blockers, {listed} AS checklist, len(b) = 0 AND NOT reviewed AS ready_for_human_review,
          len(b) = 0 AND reviewed AS valid_for_ingestion, NOT reviewed AS review_required FROM r""")
    def manifest_review(spark, folder):
        got = manifests.manifest_review(manifest_rows(spark, folder), file_rows(spark, folder))
        items = F.transform("checklist", lambda i: F.concat(i["id"], F.lit("="), i["passed"].cast("string")))
        return got.select("source_id", F.array_join("blockers", "; ").alias("blockers"), F.array_join(items, ";").alias("checklist"),
                          "ready_for_human_review", "valid_for_ingestion", "review_required")

    path = "nullif(local_path, '')"

    @catalog.add("manifest_drafts", _JOINED + f"""
        , e AS (SELECT *, CASE WHEN {path} LIKE '/%' THEN 'local_path must be repo-relative'
            WHEN {path} IS NULL OR {_OUT} THEN 'local_path must stay under ignored data/ or samples/ directories'
            WHEN actual IS NULL THEN 'local_path file does not exist for manifest drafting' END AS error FROM j)
        SELECT source_id, CASE WHEN error IS NULL THEN actual END AS checksum, CASE WHEN error IS NULL THEN false END AS reviewed,
          CASE WHEN error IS NULL THEN coalesce(nullif(notes, ''), 'TODO: human source review required before ingestion') ELSE notes END AS notes, error FROM e""")
    def manifest_drafts(spark, folder):
        drafted, rejected = manifests.draft_manifests(manifest_rows(spark, folder).drop("checksum", "reviewed"), file_rows(spark, folder))
        return drafted.select("source_id", "checksum", "reviewed", "notes").unionByName(rejected.select("source_id", "notes", "error"), allowMissingColumns=True)

    onboarding = {
        "request_id": "c_custkey", "state_id": "concat('ST-', c_custkey % 55)", "ac_number": "CAST(c_custkey % 20 AS INT)",
        "part_number": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 6 - 2 AS INT) END",
        "pdf_path": "CASE c_custkey % 4 WHEN 0 THEN '/abs/x.pdf' WHEN 1 THEN 'tmp/x.pdf' ELSE concat('data/', c_custkey, '.pdf') END",
        "test_name_env": "CASE c_custkey % 5 WHEN 0 THEN 'BAD-NAME' WHEN 1 THEN '__' ELSE 'TEST_NAME' END",
        "manifest_path": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'data/m.json' END", "source_id": "concat('src-', c_custkey * 2)",
    }
    rules = [
        ("s.state_id IS NULL", "'unknown state_id: ' || q.state_id"), ("ac_number <= 0", _t("ac_number must be positive")),
        ("part_number <= 0", _t("part_number must be positive")),
        ("NOT regexp_matches(replace(test_name_env, '_', ''), '^[A-Za-z0-9]+$')", _t("test name env var must be alphanumeric with underscores")),
        ("pdf_path LIKE '/%'", _t("pdf path must be repo-relative so raw local paths are not printed")),
        ("split_part(pdf_path, '/', 1) NOT IN ('data', 'samples')", _t("pdf path should stay under ignored data/ or samples/ directories")),
        ("manifest_path IS NULL", _t("source manifest and source id are required before onboarding")),
        ("manifest_path IS NOT NULL AND m.source_id IS NULL", "'unknown source_id: ' || q.source_id"),
        ("manifest_path IS NOT NULL AND m.state_id <> q.state_id", _t("source manifest state_id must match workflow state")),
        ("manifest_path IS NOT NULL AND m.source_id IS NOT NULL AND m.local_path IS DISTINCT FROM pdf_path", _t("source manifest local_path must match workflow PDF")),
    ]

    @catalog.add("onboarding_rules", f"""
        WITH mf AS (SELECT *, {_list(*FIELD_RULES)} AS own FROM ({MANIFEST_SQL})),
        q AS (SELECT {", ".join(f"{v} AS {k}" for k, v in onboarding.items())} FROM customer),
        s AS (SELECT concat('ST-', s_suppkey) AS state_id FROM supplier)
        SELECT request_id, array_to_string(list_concat({_list(*rules)}, CASE WHEN manifest_path IS NOT NULL AND m.source_id IS NOT NULL THEN own ELSE [] END), '; ') AS blockers
        FROM q LEFT JOIN s ON q.state_id = s.state_id LEFT JOIN mf m ON q.source_id = m.source_id""")
    def onboarding_rules(spark, folder):
        asked = _select(table(spark, folder, "customer"), onboarding)
        states = table(spark, folder, "supplier").selectExpr("concat('ST-', s_suppkey) AS state_id")
        got = manifests.onboarding_blockers(asked, states, manifest_rows(spark, folder))
        return got.select("request_id", F.array_join("blockers", "; ").alias("blockers"))

    # -- states -------------------------------------------------------------------------
    state_rules = _list(
        ("capability = 'wrong_value'", "'invalid data_capability: ' || capability"),
        ("confidence = 'rumour'", "'invalid schedule provenance confidence: ' || confidence"),
        ("label = 'Unlisted'", _t("schedule provenance source is not listed: Unlisted")),
        ("label = 'Report' AND source_type <> first_type", _t("schedule provenance source_type must match the listed source")),
        ("confidence = 'official' AND source_type <> 'official_portal'", _t("official schedule provenance must come from an official portal")),
        ("checked IS NULL", _t("missing source freshness")),
    )

    @catalog.add("state_rules", f"SELECT state_id, array_to_string({state_rules}, '; ') AS blockers FROM ({REGISTRY_SQL})")
    def state_rules_job(spark, folder):
        return registry.state_blockers(registry_rows(spark, folder)).select("state_id", F.array_join("blockers", "; ").alias("blockers"))

    @catalog.add("state_scan", f"SELECT state_id, enumeration_end, claims_end, final_roll_date, checked AS last_verified, array_to_string(string_split(languages, ','), '|') AS languages FROM ({REGISTRY_SQL})")
    def state_scan(spark, folder):
        return registry_rows(spark, folder).select(
            "state_id", "sir_schedule.enumeration_end", "sir_schedule.claims_end", "sir_schedule.final_roll_date",
            F.col("official_sources")[0]["last_verified"].alias("last_verified"), F.array_join("languages", "|").alias("languages"))

    @catalog.add("state_payload", f"""
        SELECT state_id, name, capability AS data_capability, ready AS public_launch_ready, status AS sir_status, CAST(claims_end AS VARCHAR) AS claims_end,
          CAST(final_roll_date AS VARCHAR) AS final_roll_date, 'Report|Voters portal' AS labels, coalesce(CAST(checked AS VARCHAR), '-') AS last_verified, confidence FROM ({REGISTRY_SQL})""")
    def state_payload(spark, folder):
        got = registry.state_payload(registry_rows(spark, folder))
        return got.select(
            "state_id", "name", "data_capability", "public_launch_ready", "sir_status", F.col("sir_schedule.claims_end").alias("claims_end"), "final_roll_date",
            F.array_join(F.transform("official_sources", lambda s: s["label"]), "|").alias("labels"),
            F.coalesce(F.col("official_sources")[1]["last_verified"], F.lit("-")).alias("last_verified"), "schedule_provenance.confidence")

    names = "CASE languages WHEN 'en,hi,mr' THEN 'English|Hindi|Marathi' WHEN 'en,bn,xx' THEN 'English|Bengali|xx' ELSE 'English' END"
    planned = "CASE languages WHEN 'en,hi,mr' THEN 'Hindi, Marathi' WHEN 'en,bn,xx' THEN 'Bengali, xx' END"

    @catalog.add("state_summary", f"""
        SELECT state_id, {names} AS languages, 'Marathi' AS default_language,
          CASE status WHEN 'enumeration_scheduled' THEN 'Enumeration scheduled' WHEN 'final_roll_published' THEN 'Final roll published' ELSE 'claims open now' END AS status,
          {_day('enumeration_end')} AS enumeration_end, {_day('claims_end')} AS claims_end, {_day('final_roll_date')} AS final_roll_date,
          CASE WHEN first_type = 'official_portal' THEN portal ELSE portal || '/v' END AS official_link,
          CASE WHEN checked IS NULL THEN '' ELSE 'Report: last checked ' || {_day('checked')} END AS freshness,
          CASE WHEN {planned} IS NULL THEN 'English UI is available now.' ELSE 'English UI is available now. ' || {planned} || ' translations are planned and will be added after human review.' END AS ui_readiness,
          1 + coalesce(len(string_split({planned}, ', ')), 0) AS ui_languages FROM ({REGISTRY_SQL})""")
    def state_summary(spark, folder):
        got = registry.state_summary(registry_rows(spark, folder))
        return got.select(
            "state_id", F.array_join("languages", "|").alias("languages"), "default_language", "status", "enumeration_end", "claims_end", "final_roll_date",
            "official_link", F.coalesce(F.col("source_freshness")[0], F.lit("")).alias("freshness"), "ui_readiness", F.size("ui_languages").alias("ui_languages"))

    end = " Use official portals and local BLO/ERO channels for final verification."

    @catalog.add("search_availability", f"""
        SELECT state_id, replace(capability, '_', ' ') AS capability, CASE
          WHEN confidence <> 'official' THEN {_t('Indexed public search remains off until schedule provenance comes from an official source.' + end)}
          WHEN NOT ready THEN {_t('Indexed public search is not launch-ready.' + end)}
          WHEN capability = 'validated_indexed_search' THEN 'Validated indexed search can be enabled with abuse protection and scoped queries.'
          ELSE 'Guidance and official links are available; indexed search remains disabled.' END AS message FROM ({REGISTRY_SQL})""")
    def search_availability(spark, folder):
        return registry.search_availability(registry_rows(spark, folder)).select("state_id", "capability", "message")

    @catalog.add("forms_scan", """
        SELECT p_partkey, 'form' AS kind, 'form_6' AS id, 'Form ' || p_name AS label FROM part
        UNION ALL SELECT p_partkey, 'form', 'form_' || p_size, 'Size ' || p_type FROM part WHERE p_size <> 6
        UNION ALL SELECT p_partkey, 'document', 'identity', p_name || '|proof ' || p_type FROM part""")
    def forms_scan(spark, folder):
        documents = table(spark, folder, "part").selectExpr(
            "p_partkey",
            "map_concat(map('form_6', named_struct('label', concat('Form ', p_name), 'purpose', p_type, 'official_portal', 'u')), "
            "if(p_size = 6, map(), map(concat('form_', p_size), named_struct('label', concat('Size ', p_type), 'purpose', p_type, 'official_portal', 'u')))) AS forms",
            "map('identity', array(p_name, concat('proof ', p_type))) AS common_documents",
        )
        forms, kinds = readers.catalogue_rows(documents, "p_partkey")
        return forms.select("p_partkey", F.lit("form").alias("kind"), F.col("form_id").alias("id"), "label").unionByName(
            kinds.select("p_partkey", F.lit("document").alias("kind"), F.col("category").alias("id"), F.array_join("documents", "|").alias("label")))

    @catalog.add("forms_payload", """
        SELECT (SELECT string_agg(label, '|' ORDER BY id) FROM (SELECT CASE n_nationkey WHEN 1 THEN 'form_6' WHEN 2 THEN 'form_7' WHEN 3 THEN 'form_8' ELSE 'form_n' || n_nationkey END AS id, 'Form ' || n_name AS label FROM nation)) AS labels,
               (SELECT count(*) FROM region) AS categories""")
    def forms_payload(spark, folder):
        row = registry.forms_payload(*forms_rows(spark, folder))
        return row.select(F.array_join(F.transform("forms", lambda f: f["label"]), "|").alias("labels"),
                          F.size("common_documents").alias("categories"))

    # -- requests ------------------------------------------------------------------------
    gate = {
        "request_id": "c_custkey", "state_id": "concat('ST-', c_custkey % 110)", "turnstile_verified": "c_custkey % 3 <> 0", "use_sanitized_pilot": "c_custkey % 5 = 0",
        "require_scope": "c_custkey % 31 <> 0", "max_results": "CASE WHEN c_custkey % 37 = 0 THEN 50 ELSE 20 END", "allow_bulk_export": "c_custkey % 41 = 0",
        "reveal_full_epic": "false", "reveal_raw_address": "false", "log_full_query": "c_custkey % 43 = 0", "rate_limit_max_requests": "CASE WHEN c_custkey % 47 = 0 THEN 500 ELSE 30 END",
        "rate_limit_window_seconds": "CASE WHEN c_custkey % 53 = 0 THEN 5 ELSE 60 END",
    }

    @catalog.add("search_gate", f"""
        WITH q AS (SELECT {", ".join(f"{v} AS {k}" for k, v in gate.items())} FROM customer), s AS ({REGISTRY_SQL}),
        g AS (SELECT request_id, CASE WHEN s.state_id IS NULL THEN 'unknown state_id: ' || q.state_id
          WHEN NOT require_scope THEN 'public search must require geographic scope' WHEN max_results > 20 THEN 'public search max_results must be 20 or less'
          WHEN allow_bulk_export THEN 'bulk export must be disabled' WHEN log_full_query THEN 'full search query logging must be disabled'
          WHEN rate_limit_max_requests > 120 THEN 'search rate limit must be between 1 and 120 requests'
          WHEN rate_limit_window_seconds < 10 THEN 'search rate limit window must be between 10 and 3600 seconds'
          WHEN use_sanitized_pilot THEN NULL WHEN NOT ready THEN 'indexed search is not enabled for public launch in this state'
          WHEN capability NOT IN ('pilot_indexed_search', 'validated_indexed_search') THEN 'indexed search is not available for this state'
          WHEN confidence <> 'official' THEN 'public search requires official schedule provenance'
          WHEN NOT turnstile_verified THEN 'public search requires abuse-prevention verification' END AS refusal FROM q LEFT JOIN s ON q.state_id = s.state_id)
        SELECT request_id, refusal, refusal IS NULL AS allowed FROM g""")
    def search_gate(spark, folder):
        asked = _select(table(spark, folder, "customer"), gate)
        return requests.search_gate(asked, registry_rows(spark, folder)).select("request_id", "refusal", "allowed")

    local = {
        "request_id": "o_orderkey", "state_id": "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'IN' END", "ac_number": "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 5 END",
        "query": "CASE o_orderkey % 9 WHEN 0 THEN ' a ' WHEN 1 THEN NULL ELSE o_orderpriority END", "limit": "CASE WHEN o_orderkey % 7 = 0 THEN 21 ELSE 10 END",
        "threshold": "CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 0.2 END", "part_number": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 7 END",
        "max_quality_issue_rate": "CASE WHEN o_orderkey % 17 = 0 THEN -0.1 ELSE 0.05 END",
    }
    short = "length(trim(coalesce(query, ''))) < 2"
    rule_sets = {
        "local_search": _list(("state_id = ''", _t("state_id is required")), ("coalesce(ac_number, 0) <= 0", _t("ac_number must be positive")),
            (short, _t("search query must contain at least two normalized characters")), ('"limit" > 20', _t("limit must be between 1 and 20")),
            ("threshold > 1", _t("similarity threshold must be between 0 and 1"))),
        "public_search": _list(("query IS NULL", _t("query must be a string")), ("length(trim(query)) < 2", _t("query must contain at least two characters")),
            ("ac_number IS NULL", _t("name search must be scoped by Assembly Constituency")), ("part_number IS NOT NULL AND ac_number IS NULL", _t("part_number search also requires ac_number")),
            ('"limit" > 20', _t("limit must be between 1 and 20"))),
        "readiness": _list(("state_id = ''", _t("state_id is required")), ("coalesce(ac_number, 0) <= 0", _t("ac_number must be positive")),
            ("part_number <= 0", _t("part_number must be positive")), ("max_quality_issue_rate < 0", _t("max_quality_issue_rate must be between 0 and 1"))),
    }

    quoted = ", ".join(f'{v} AS "{k}"' for k, v in local.items())

    @catalog.add("request_rules", f"""
        WITH q AS (SELECT {quoted} FROM orders)
        SELECT request_id, {", ".join(f"array_to_string({r}, '; ') AS {n}" for n, r in rule_sets.items())} FROM q""")
    def request_rules(spark, folder):
        asked = table(spark, folder, "orders").selectExpr(*[f"{v} AS `{k}`" for k, v in local.items()])
        return asked.select(
            "request_id", F.array_join(requests.local_search_blockers(), "; ").alias("local_search"),
            F.array_join(requests.public_search_blockers(), "; ").alias("public_search"), F.array_join(requests.readiness_blockers(), "; ").alias("readiness"))

    # JSON payloads: every kind of wrong field in turn.
    search_json = (
        "concat('{\"state_id\": ', CASE o_orderkey % 12 WHEN 0 THEN '5' WHEN 1 THEN '\" I \"' ELSE '\"IN-MH\"' END, "
        "', \"query\": ', CASE o_orderkey % 10 WHEN 0 THEN '\"  x \"' WHEN 1 THEN 'null' ELSE '\"Some  name\"' END, "
        "', \"ac_number\": ', CASE o_orderkey % 9 WHEN 0 THEN '\"7\"' WHEN 1 THEN '1000' WHEN 2 THEN 'true' WHEN 3 THEN '1.5' ELSE '172' END, "
        "CASE o_orderkey % 8 WHEN 0 THEN ', \"part_number\": null' WHEN 1 THEN ', \"part_number\": 0' WHEN 2 THEN ', \"part_number\": \"x\"' ELSE '' END, "
        "CASE o_orderkey % 7 WHEN 0 THEN ', \"limit\": 50' WHEN 1 THEN ', \"limit\": false' ELSE '' END, "
        "CASE o_orderkey % 5 WHEN 0 THEN ', \"use_sanitized_pilot\": 1' WHEN 1 THEN ', \"turnstile_verified\": true' ELSE '' END, "
        "CASE o_orderkey % 23 WHEN 0 THEN ', \"zeta\": 1, \"alpha\": {\"limit\": 3}' ELSE '' END, '}')"
    )

    @catalog.add("search_request_rules", """
        SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 23 = 0 THEN 'unknown fields: alpha, zeta'
          WHEN o_orderkey % 12 = 0 THEN 'state_id must be a string' WHEN o_orderkey % 12 = 1 THEN 'state_id length is invalid'
          WHEN o_orderkey % 10 = 0 THEN 'query length is invalid' WHEN o_orderkey % 10 = 1 THEN 'query must be a string'
          WHEN o_orderkey % 9 IN (0, 2, 3) THEN 'ac_number must be an integer' WHEN o_orderkey % 9 = 1 THEN 'ac_number is out of range'
          WHEN o_orderkey % 8 = 2 THEN 'part_number must be an integer' WHEN o_orderkey % 8 = 1 THEN 'part_number is out of range'
          WHEN o_orderkey % 7 = 1 THEN 'limit must be an integer' WHEN o_orderkey % 7 = 0 THEN 'limit is out of range'
          WHEN o_orderkey % 5 = 0 THEN 'use_sanitized_pilot must be a boolean' END AS error FROM orders""")
    def search_request_rules(spark, folder):
        asked = table(spark, folder, "orders").selectExpr("o_orderkey AS request_id", f"{search_json} AS payload")
        return asked.select("request_id", requests.search_payload_error(F.col("payload")).alias("error"))

    guidance_json = (
        "concat('{\"state_id\": \"IN-MH\", \"situation\": ', CASE c_custkey % 6 WHEN 0 THEN '\"lost\"' WHEN 1 THEN '7' WHEN 2 THEN '\"x\"' ELSE '\" new_voter \"' END, "
        "CASE c_custkey % 5 WHEN 0 THEN ', \"blo_visited\": \"maybe\"' WHEN 1 THEN ', \"base_roll_found\": null' WHEN 2 THEN ', \"current_roll_found\": \"yes\"' ELSE '' END, "
        "CASE c_custkey % 19 WHEN 0 THEN ', \"today\": \"2026-01-01\"' ELSE '' END, '}')"
    )

    @catalog.add("guidance_request_rules", """
        SELECT c_custkey AS request_id, CASE WHEN c_custkey % 19 = 0 THEN 'unknown fields: today' WHEN c_custkey % 6 = 1 THEN 'situation must be a string'
          WHEN c_custkey % 6 = 2 THEN 'situation length is invalid' WHEN c_custkey % 6 = 0 THEN 'situation is not supported'
          WHEN c_custkey % 5 = 1 THEN 'base_roll_found must be a string' WHEN c_custkey % 5 = 0 THEN 'blo_visited must be yes, no, or unknown' END AS error FROM customer""")
    def guidance_request_rules(spark, folder):
        asked = table(spark, folder, "customer").selectExpr("c_custkey AS request_id", f"{guidance_json} AS payload")
        return asked.select("request_id", requests.guidance_payload_error(F.col("payload")).alias("error"))

    # -- guidance ------------------------------------------------------------------------
    due = "CASE WHEN situation IN ('existing_voter', 'portal_failed') THEN coalesce(enumeration_end, claims_end, final_roll_date) ELSE coalesce(claims_end, final_roll_date) END"
    unreached = "situation = 'existing_voter' AND (enumeration_form_received = 'no' OR blo_visited = 'no')"
    in_base = "situation = 'missing_name' AND base_roll_found = 'yes'"

    @catalog.add("guidance_api", f"""
        WITH q AS ({REQUEST_SQL}), s AS ({REGISTRY_SQL}), j AS (SELECT q.*, s.state_id AS known, portal, {due} AS due, {_by_situation(words.SERVICE, 3)} AS act FROM q LEFT JOIN s ON q.state_id = s.state_id)
        SELECT request_id, CASE WHEN {unreached} THEN 'high' ELSE {_by_situation(words.SERVICE, 0)} END AS priority, {_by_situation(words.SERVICE, 1)} AS title, {_by_situation(words.SERVICE, 2)} AS summary,
          array_to_string(CASE WHEN {unreached} THEN list_concat([{_t(words.NO_FORM_YET)}], act) WHEN {in_base} THEN list_concat(act[1:2], [{_t(words.BASE_ROLL_KNOWN)}], act[3:]) ELSE act END, '|') AS actions,
          array_to_string({_by_situation(words.SERVICE, 4)}, '|') AS documents, CASE WHEN known IS NOT NULL THEN portal || '|' || portal || '/v' END AS official_links, due AS deadline,
          CASE WHEN today > due THEN {_t(words.OFFICIAL_PASSED)} WHEN date_diff('day', today, due) <= 3 THEN {_t(words.OFFICIAL_CLOSE)} ELSE '' END AS warnings,
          CASE WHEN known IS NULL THEN 'unknown state_id: ' || state_id WHEN situation = 'lost' THEN 'unsupported situation: lost' END AS error FROM j""")
    def guidance_api(spark, folder):
        got = guidance.guidance(request_rows(spark, folder), registry_rows(spark, folder))
        lists = [F.array_join(c, "|").alias(c) for c in ("actions", "documents", "official_links", "warnings")]
        return got.select("request_id", "priority", "title", "summary", *lists, "deadline", "error")

    web_first = _list(
        ("situation = 'existing_voter' AND current_roll_found = 'no'", _t(words.WEB_URGENT)),
        ("situation = 'existing_voter' AND enumeration_form_received = 'yes' AND enumeration_form_submitted = 'no'", _t(words.WEB_SUBMIT_FORM)),
        ("situation = 'existing_voter' AND (blo_visited = 'no' OR enumeration_form_received = 'no')", _t(words.WEB_NO_FORM_YET)))
    labelled = "replace(replace(replace({0}, '{{form_6}}', f6), '{{form_7}}', f7), '{{form_8}}', f8)"
    form = lambda k: f"(SELECT 'Form ' || n_name FROM nation WHERE n_nationkey = {k})"
    kind = lambda k: f"(SELECT r_name || '|proof ' || r_name FROM region WHERE r_regionkey = {k})"
    docs = f"array_to_string({_by_situation(words.WEB, 4)}, '|')"
    for key, name in KINDS.items():
        docs = f"replace({docs}, '@{name}', {kind(key)})"

    cards = f"""q AS ({REQUEST_SQL}), s AS ({REGISTRY_SQL}), j AS (SELECT q.*, s.state_id AS known, name, {_day(due)} AS due, {_by_situation(words.WEB, 3)} AS act, {web_first} AS extra,
            {form(1)} AS f6, {form(2)} AS f7, {form(3)} AS f8 FROM q LEFT JOIN s ON q.state_id = s.state_id),
        cards AS (SELECT request_id, CASE WHEN situation = 'existing_voter' AND current_roll_found = 'no' THEN {_t(words.WEB_URGENT_TITLE)} ELSE {_by_situation(words.WEB, 1)} END AS title,
          CASE WHEN situation = 'existing_voter' AND current_roll_found = 'no' THEN 'urgent' WHEN len(extra) > 0 THEN 'high' ELSE {_by_situation(words.WEB, 0)} END AS priority,
          {labelled.format(_by_situation(words.WEB, 2))} AS summary,
          {labelled.format(f"array_to_string(CASE WHEN {in_base} THEN list_concat(act[1:2], [{_t(words.WEB_BASE_ROLL_KNOWN)}], act[3:]) WHEN act IS NOT NULL THEN list_concat(extra, act) END, '|')")} AS actions,
          {docs} AS documents, CASE WHEN known IS NULL THEN '' WHEN due IS NULL THEN {_t(words.WEB_NO_DEADLINE)} ELSE 'Use official channels before ' || due || '.' END AS notices,
          CASE WHEN known IS NULL THEN 'unknown state_id: ' || state_id WHEN situation = 'lost' THEN 'unsupported situation: lost' END AS error, name, due FROM j)"""

    @catalog.add("guidance_web", f"WITH {cards} SELECT request_id, title, priority, summary, actions, documents, notices, error FROM cards")
    def guidance_web(spark, folder):
        got = guidance.guidance_cards(request_rows(spark, folder), registry_rows(spark, folder), *forms_rows(spark, folder))
        lists = [F.array_join(c, "|").alias(c) for c in ("actions", "documents", "notices")]
        return got.select("request_id", "title", "priority", "summary", *lists, "error")

    # Only a card that was answered can be passed on.
    @catalog.add("share_text", f"""
        WITH {cards}
        SELECT request_id, CASE WHEN error IS NULL THEN 'Demo checklist for ' || name || ': ' || title || '. Next: ' || split_part(actions, '|', 1) || ' Deadline: ' || coalesce(due, 'check official portal') || '. ' || {_t(words.SHARE_SAFETY)} END AS share,
          error FROM cards""")
    def share_text(spark, folder):
        states = registry_rows(spark, folder)
        got = guidance.guidance_cards(request_rows(spark, folder), states, *forms_rows(spark, folder))
        named = got.join(states.select("state_id", "name"), "state_id", "left")
        share = guidance.share_text("Demo", F.col("name"), F.col("title"), F.get("actions", 0), F.col("deadline"))
        return named.select("request_id", F.when(F.col("error").isNull(), share).alias("share"), "error")
