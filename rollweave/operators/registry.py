"""State-registry checks and the display rows made from the registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.functions.rules import messages, missing
from rollweave.schemas import SCHEDULE_DATES

# Allowed registry values and display words.
CAPABILITIES = ("guidance_only", "official_link_search", "pilot_indexed_search", "validated_indexed_search")
SEARCHABLE = ("pilot_indexed_search", "validated_indexed_search")
CONFIDENCES = ("official", "reported")
OFFICIAL = "official_portal"
LANGUAGE_NAMES = {"bn": "Bengali", "en": "English", "hi": "Hindi", "mr": "Marathi"}
STATUS_LABELS = {
    "enumeration_scheduled": "Enumeration scheduled",
    "final_roll_published": "Final roll published",
}
REQUIRED_KEYS = (
    "state_id", "eci_state_code", "name", "short_name", "languages", "scripts", "default_language",
    "sir_schedule", "schedule_provenance", "ceo_portal", "official_sources", "base_roll_years",
    "historical_source_shape", "current_roll_source_shape", "data_capability", "parser_status",
    "public_launch_ready", "privacy_notes",
)


def matching_source() -> Column:
    """First listed source that carries the provenance label, NULL when none does."""
    label = F.col("schedule_provenance.label")
    return F.get(F.filter("official_sources", lambda s: s["label"] == label), F.lit(0))


def state_blockers(states: DataFrame) -> DataFrame:
    """Registry rows with every reason they are not acceptable."""
    c = F.col
    confidence, kind = c("schedule_provenance.confidence"), c("schedule_provenance.source_type")
    absent = [
        (c(k).isNull(), f"missing required key: {k}") for k in REQUIRED_KEYS if k in states.columns
    ]
    source = c("_source")
    rules = absent + [
        (~c("data_capability").isin(*CAPABILITIES),
         F.concat(F.lit("invalid data_capability: "), c("data_capability"))),
        (c("sir_schedule").isNotNull() & c("sir_schedule.phase").isNull(), "missing required key: phase"),
        (c("sir_schedule").isNotNull() & c("sir_schedule.status").isNull(), "missing required key: status"),
        (~confidence.isin(*CONFIDENCES),
         F.concat(F.lit("invalid schedule provenance confidence: "), confidence)),
        (source.isNull(), F.concat(
            F.lit("schedule provenance source is not listed: "),
            F.coalesce("schedule_provenance.label", F.lit("")))),
        (kind != source["source_type"], "schedule provenance source_type must match the listed source"),
        ((confidence == "official") & (kind != OFFICIAL),
         "official schedule provenance must come from an official portal"),
        (missing(c("schedule_provenance.notes")), "schedule provenance must include notes"),
        (F.exists("official_sources", lambda s: s["last_verified"].isNull()), "missing source freshness"),
    ]
    return states.withColumn("_source", matching_source()).withColumn("blockers", messages(rules)).drop("_source")


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def state_payload(states: DataFrame) -> DataFrame:
    """Nested public form of the registry, dates as ISO text."""
    c = F.col
    return states.select(
        "state_id", "name", "languages", "data_capability", "public_launch_ready",
        c("sir_schedule.status").alias("sir_status"),
        F.struct(
            c("sir_schedule.phase").alias("phase"),
            *[_iso(c(f"sir_schedule.{d}")).alias(d) for d in SCHEDULE_DATES],
            c("sir_schedule.status").alias("status"),
        ).alias("sir_schedule"),
        "schedule_provenance", "ceo_portal",
        _iso(c("sir_schedule.final_roll_date")).alias("final_roll_date"),
        F.transform("official_sources", lambda s: F.struct(
            s["label"].alias("label"), s["url"].alias("url"), s["source_type"].alias("source_type"),
            _iso(s["last_verified"]).alias("last_verified"),
        )).alias("official_sources"),
    )


def forms_payload(forms: DataFrame, documents: DataFrame) -> DataFrame:
    """The forms catalogue as one row (a catalogue has a handful of forms)."""
    rows = forms.agg(F.array_sort(F.collect_list(
        F.struct("form_id", "label", "purpose", "official_portal"))).alias("forms"))
    kinds = documents.agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("category", "documents")))).alias("common_documents"))
    return rows.join(kinds, F.lit(True))


def display_date(c: Column) -> Column:
    return F.date_format(c, "d MMM yyyy")


def _named(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for p in table.items() for v in p]), c)


def official_link(portal: Column, sources: Column) -> Column:
    first = F.get(F.filter(sources, lambda s: s["source_type"] == OFFICIAL), F.lit(0))
    return F.coalesce(first["url"], portal)


def ui_languages(names: Column) -> Column:
    """English is available, every other language planned."""
    planned = F.transform(
        F.filter(names, lambda n: n != "English"),
        lambda n: F.struct(F.lower(n).alias("code"), n.alias("label"), F.lit("planned").alias("status")),
    )
    english = F.array(F.struct(F.lit("en").alias("code"), F.lit("English").alias("label"),
                               F.lit("available").alias("status")))
    return F.concat(english, planned)


def ui_readiness(names: Column) -> Column:
    planned = F.array_join(F.filter(names, lambda n: n != "English"), ", ")
    return F.when(planned == "", "English UI is available now.").otherwise(F.concat(
        F.lit("English UI is available now. "), planned,
        F.lit(" translations are planned and will be added after human review."),
    ))


def state_summary(states: DataFrame) -> DataFrame:
    """Display row per state: language names, status label, dates, official link, sources."""
    c = F.col
    status = c("sir_schedule.status")
    names = F.transform("languages", lambda x: F.coalesce(_named(LANGUAGE_NAMES, x), x))
    return states.select(
        "state_id", "name", names.alias("languages"),
        F.coalesce(_named(LANGUAGE_NAMES, c("default_language")), c("default_language")).alias("default_language"),
        c("data_capability").alias("capability"), "public_launch_ready",
        F.coalesce(_named(STATUS_LABELS, status), F.replace(status, F.lit("_"), F.lit(" "))).alias("status"),
        display_date(c("sir_schedule.enumeration_end")).alias("enumeration_end"),
        display_date(c("sir_schedule.claims_end")).alias("claims_end"),
        display_date(c("sir_schedule.final_roll_date")).alias("final_roll_date"),
        official_link(c("ceo_portal"), c("official_sources")).alias("official_link"),
        F.transform("official_sources", lambda s: s["label"]).alias("source_labels"),
        F.transform("official_sources", lambda s: F.concat(
            s["label"], F.lit(": last checked "), display_date(s["last_verified"]))).alias("source_freshness"),
        F.struct("schedule_provenance.label", "schedule_provenance.confidence",
                 "schedule_provenance.notes").alias("schedule_provenance"),
        ui_languages(names).alias("ui_languages"), ui_readiness(names).alias("ui_readiness"),
    )


def search_availability(states: DataFrame) -> DataFrame:
    """What to tell a visitor about name search in each state; first reason wins."""
    c = F.col
    official_end = " Use official portals and local BLO/ERO channels for final verification."
    text = (
        F.when(c("schedule_provenance.confidence") != "official",
               "Indexed public search remains off until schedule provenance comes from an official source."
               + official_end)
        .when(~c("public_launch_ready"), "Indexed public search is not launch-ready." + official_end)
        .when(c("data_capability") == "validated_indexed_search",
              "Validated indexed search can be enabled with abuse protection and scoped queries.")
        .otherwise("Guidance and official links are available; indexed search remains disabled.")
    )
    return states.select(
        "state_id", "name",
        F.replace("data_capability", F.lit("_"), F.lit(" ")).alias("capability"),
        c("schedule_provenance.confidence").alias("confidence"), text.alias("message"),
    )
