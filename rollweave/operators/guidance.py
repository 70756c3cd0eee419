"""Guidance for a table of requests: a rule table joined on the situation, then adjusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.operators import guidance_text as words
from rollweave.operators.registry import display_date
from rollweave.operators.requests import STATUS_FIELDS

ENUMERATION_CASES = ("existing_voter", "portal_failed")
CLOSE_DAYS = 3


def _rules(df: DataFrame, edition: dict) -> DataFrame:
    """The eight-row rule table of an edition."""
    rows = [(s, *r) for s, r in edition.items()]
    return df.sparkSession.createDataFrame(
        rows,
        "situation string, priority string, title string, summary string, "
        "actions array<string>, documents array<string>",
    )


def _with_defaults(requests: DataFrame) -> DataFrame:
    out = requests
    for f in STATUS_FIELDS:
        known = F.col(f) if f in requests.columns else F.lit(None).cast("string")
        out = out.withColumn(f, F.coalesce(known, F.lit("unknown")))
    if "today" not in out.columns:
        out = out.withColumn("today", F.lit(None).cast("date"))
    return out


def deadline(situation: Column, schedule: Column) -> Column:
    """Claims end or final roll; enumeration end first for those who must return a form."""
    general = F.coalesce(schedule["claims_end"], schedule["final_roll_date"])
    return F.when(
        situation.isin(*ENUMERATION_CASES), F.coalesce(schedule["enumeration_end"], general)
    ).otherwise(general)


def schedule_warnings(today: Column, due: Column) -> Column:
    return F.array_compact(F.array(
        F.when(today > due, words.OFFICIAL_PASSED)
        .when(F.datediff(due, today) <= CLOSE_DAYS, words.OFFICIAL_CLOSE)
    ))


def _put(actions: Column, at: int, text: str) -> Column:
    return F.array_insert(actions, at + 1, F.lit(text))


def _error() -> Column:
    """Why a request is blocked; NULL when it is answered. Of the joined columns _known and title."""
    return F.coalesce(
        F.when(F.col("_known").isNull(), F.concat(F.lit("unknown state_id: "), F.coalesce("state_id", F.lit("")))),
        F.when(F.col("title").isNull(), F.concat(F.lit("unsupported situation: "), F.coalesce("situation", F.lit("")))),
    )


def guidance(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Service answers: one row per request; unknown states and situations are blocked rows.

    ``requests(state_id, situation, statuses..., [today])``; ``states`` as read by the registry
    reader. Both other sides are small and Spark broadcasts them by their size.
    """
    c = F.col
    registry = states.select(
        "state_id", "sir_schedule", "ceo_portal", "official_sources", F.lit(True).alias("_known")
    )
    rules = F.broadcast(_rules(requests, words.SERVICE))  # eight rows
    joined = _with_defaults(requests).join(registry, "state_id", "left").join(rules, "situation", "left")
    existing, no = c("situation") == "existing_voter", F.lit("no")
    unreached = existing & ((c("enumeration_form_received") == no) | (c("blo_visited") == no))
    in_base = (c("situation") == "missing_name") & (c("base_roll_found") == "yes")
    due = deadline(c("situation"), c("sir_schedule"))
    links = F.array_distinct(F.concat(
        F.array("ceo_portal"), F.transform(F.slice("official_sources", 1, 2), lambda s: s["url"])
    ))
    return joined.select(
        *requests.columns,
        F.when(unreached, "high").otherwise(c("priority")).alias("priority"), "title", "summary",
        F.when(unreached, _put(c("actions"), 0, words.NO_FORM_YET))
        .when(in_base, _put(c("actions"), 2, words.BASE_ROLL_KNOWN))
        .otherwise(c("actions")).alias("actions"),
        "documents", links.alias("official_links"), due.alias("deadline"),
        F.transform("official_sources", lambda s: s["label"]).alias("source_labels"),
        schedule_warnings(c("today"), due).alias("warnings"),
        _error().alias("error"),
    )


def _labels(text: Column, labels: Column) -> Column:
    """Form placeholders replaced by the catalogue's labels, or by the form id itself."""
    out = text
    for form in ("form_6", "form_7", "form_8"):
        out = F.replace(out, F.lit("{" + form + "}"), F.coalesce(labels[form], F.lit(form)))
    return out


def guidance_cards(requests: DataFrame, states: DataFrame, forms: DataFrame, documents: DataFrame) -> DataFrame:
    """Web cards: shorter text, three escalations for existing voters, document lists and
    form labels from the catalogue (``forms``, ``documents`` as read by the forms reader). One row per
    request; unknown states and situations are rows with an error, as in ``guidance``."""
    c = F.col
    catalogue = F.broadcast(  # one row: a handful of forms and categories
        forms.agg(F.map_from_entries(F.collect_list(F.struct("form_id", "label"))).alias("_forms"))
        .join(documents.agg(F.map_from_entries(F.collect_list(F.struct("category", "documents"))).alias("_docs")), F.lit(True))
    )
    rules = _rules(requests, words.WEB).join(catalogue, F.lit(True)).select(
        "situation", "priority", "title", _labels(c("summary"), c("_forms")).alias("summary"),
        F.transform("actions", lambda a: _labels(a, c("_forms"))).alias("actions"),
        F.flatten(F.transform("documents", lambda d: F.when(
            d.startswith("@"),
            F.coalesce(c("_docs")[d.substr(F.lit(2), F.length(d))], F.array().cast("array<string>")),
        ).otherwise(F.array(d)))).alias("documents"),
    )
    schedule = states.select("state_id", "sir_schedule", F.lit(True).alias("_known"))
    joined = (
        _with_defaults(requests).join(schedule, "state_id", "left")
        .join(F.broadcast(rules), "situation", "left")  # eight rows
    )
    existing = c("situation") == "existing_voter"
    steps = [
        (existing & ((c("blo_visited") == "no") | (c("enumeration_form_received") == "no")), words.WEB_NO_FORM_YET),
        (existing & (c("enumeration_form_received") == "yes") & (c("enumeration_form_submitted") == "no"),
         words.WEB_SUBMIT_FORM),
        (existing & (c("current_roll_found") == "no"), words.WEB_URGENT),
    ]
    # The step checked last stands first.
    extra = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in reversed(steps)]))
    urgent, raised = steps[2][0], steps[0][0] | steps[1][0]
    in_base = (c("situation") == "missing_name") & (c("base_roll_found") == "yes")
    due = display_date(deadline(c("situation"), c("sir_schedule")))
    notice = F.when(c("_known"), F.array(F.coalesce(
        F.concat(F.lit("Use official channels before "), due, F.lit(".")), F.lit(words.WEB_NO_DEADLINE)
    ))).otherwise(F.array().cast("array<string>"))
    return joined.select(
        *requests.columns,
        F.when(urgent, words.WEB_URGENT_TITLE).otherwise(c("title")).alias("title"),
        F.when(urgent, "urgent").when(raised, "high").otherwise(c("priority")).alias("priority"),
        "summary",
        F.when(in_base, _put(c("actions"), 2, words.WEB_BASE_ROLL_KNOWN))
        .otherwise(F.concat(extra, c("actions"))).alias("actions"),
        "documents", notice.alias("notices"), due.alias("deadline"), _error().alias("error"),
    )


def share_text(brand: str, state_name: Column, title: Column, first_action: Column, due: Column) -> Column:
    """Text for passing a card on, under the name of the publishing site."""
    return F.concat(
        F.lit(f"{brand} checklist for "), state_name, F.lit(": "), title, F.lit(". Next: "), first_action,
        F.lit(" Deadline: "), F.coalesce(due, F.lit("check official portal")), F.lit(". "),
        F.lit(words.SHARE_SAFETY),
    )
