"""Guidance decision tables.

Fixed values: priorities, titles, summaries, actions and documents per situation, in the two
editions users see (service answers and web cards). ``{form_6}`` and the like stand for form
labels, ``@category`` for the documents of a catalogue category.
"""

OFFICIAL_PASSED = (
    "The listed deadline appears to have passed. Check the official CEO/ECI portal for late remedies "
    "or appeal options."
)
OFFICIAL_CLOSE = (
    "The deadline is very close. Prefer the official portal and also contact the BLO/ERO offline."
)
NO_FORM_YET = "Contact your BLO or local ERO office because the enumeration form has not reached you yet."
BASE_ROLL_KNOWN = "Mention that your older/base-roll record appears to exist when you contact officials."

SERVICE = {
    "existing_voter": (
        "medium", "Verify and submit your SIR details",
        "You appear to be an existing voter. The safest next step is to verify your roll entry and complete the SIR enumeration process.",
        ["Confirm your name in the current electoral roll using the official portal or local BLO support.",
         "If you receive a SIR enumeration form, verify the pre-filled details and submit it before the enumeration deadline.",
         "Keep the acknowledgement copy or submission confirmation safely."],
        ["Existing voter ID or EPIC reference", "Any document needed to correct changed details"],
    ),
    "new_voter": (
        "high", "Register as a new voter",
        "If you are eligible but not registered, use Form 6 through the official voter services channel or submit it offline to election officials.",
        ["Check eligibility for the state qualifying date.",
         "Prepare identity, address, and age proof.",
         "Submit Form 6 on the official portal or through the ERO/BLO route.",
         "Track the application and respond quickly if officials ask for clarification."],
        ["Identity proof", "Current address proof", "Age or date-of-birth proof"],
    ),
    "missing_name": (
        "urgent", "Act quickly on a missing name",
        "A missing name during SIR needs fast official follow-up, especially during the claims and objections window.",
        ["Search again with alternate spelling, age, district, AC, and family details.",
         "Check whether your name appears in the draft/current roll through official channels.",
         "If still missing, file the appropriate claim during the claims and objections window.",
         "Contact BLO/ERO offline and keep acknowledgement or complaint details."],
        ["Identity proof", "Address proof", "Any previous voter ID or roll reference", "Acknowledgement copies"],
    ),
    "shifted_address": (
        "high", "Update your shifted address",
        "If your address changed, use the official correction/shift route so the roll and polling station match your current residence.",
        ["Confirm whether the shift is within the same AC or to another AC/state.",
         "Prepare current address proof.",
         "Use Form 8 or the official shift/correction workflow as applicable.",
         "Verify the updated polling station after disposal."],
        ["Current address proof", "Existing voter ID or EPIC reference"],
    ),
    "correction": (
        "medium", "Correct voter details",
        "Use Form 8 for spelling, age, address, replacement EPIC, or similar corrections through official channels.",
        ["Identify the exact field that is wrong.",
         "Prepare a document supporting the correct value.",
         "Submit Form 8 online or through the local election office.",
         "Track the request and verify the corrected roll entry."],
        ["Existing voter ID or EPIC reference", "Document supporting the correction"],
    ),
    "deceased_family": (
        "medium", "Report a deceased family member entry",
        "Use the official objection/deletion route only with supporting details and documents.",
        ["Confirm the entry in the current roll.",
         "Prepare available supporting record for the deceased elector.",
         "Submit the official deletion/objection request through Form 7 or local ERO/BLO route.",
         "Keep acknowledgement details for follow-up."],
        ["Supporting record for deletion request", "Your contact details for official follow-up"],
    ),
    "duplicate_entry": (
        "medium", "Report or resolve duplicate entries",
        "Duplicate entries should be corrected through official ERO/BLO channels so the valid entry is retained.",
        ["Note both duplicate entries without sharing them publicly.",
         "Contact the BLO/ERO and ask which entry should remain active.",
         "Submit the official objection/correction form if instructed."],
        ["Existing voter ID or roll references", "Current address proof if the duplicate relates to a shift"],
    ),
    "portal_failed": (
        "high", "Use offline fallback if the portal fails",
        "Online portal issues should not block SIR action. Use the BLO/ERO offline route and keep proof of attempts.",
        ["Retry the official portal once with a stable connection and correct mobile/EPIC details.",
         "Take note of the error and time of failure without exposing private details publicly.",
         "Contact the BLO or ERO office before the deadline.",
         "Submit the relevant form offline and keep acknowledgement."],
        ["Relevant form details", "Identity proof", "Address proof", "Acknowledgement or error reference if available"],
    ),
}

WEB_NO_FORM_YET = "Contact your BLO or local ERO because the enumeration form has not reached you yet."
WEB_SUBMIT_FORM = "Submit the received enumeration form as soon as possible and keep the acknowledgement."
WEB_URGENT = "Treat this as urgent: use the missing-name flow and contact BLO or ERO."
WEB_URGENT_TITLE = "Resolve your missing current-roll entry"
WEB_BASE_ROLL_KNOWN = "Mention that an older/base-roll record appears to exist when contacting officials."
SHARE_SAFETY = (
    "Confirm deadlines and eligibility on the official portal. Do not include EPIC, address, or other "
    "private details when forwarding."
)
WEB_NO_DEADLINE = "Check the official portal for the latest deadline."

WEB = {
    "existing_voter": (
        "medium", "Verify and submit your SIR details",
        "Confirm your roll entry and complete the SIR enumeration form if you receive one.",
        ["Verify your name through official sources.",
         "Submit the enumeration form before the deadline if you receive one.",
         "Keep the acknowledgement safely."],
        ["Existing voter reference", "Proof for any changed detail"],
    ),
    "new_voter": (
        "high", "Register as a new voter",
        "Use {form_6} through official online or offline channels if you are eligible and not registered.",
        ["Check eligibility for the qualifying date.",
         "Prepare identity, address, and age proof.",
         "Submit {form_6} through the official voter portal or ERO/BLO route."],
        ["@identity", "@address", "@age"],
    ),
    "missing_name": (
        "urgent", "Act quickly on a missing name",
        "A missing name during SIR needs fast official follow-up, especially during the claims and objections window.",
        ["Search again with alternate spelling, age, district, AC, and family details.",
         "Check the draft/current roll through official channels.",
         "Contact BLO or ERO and keep acknowledgement.",
         "File the appropriate claim before the deadline."],
        ["Identity proof", "Address proof", "Previous voter reference if available"],
    ),
    "shifted_address": (
        "high", "Update your shifted address",
        "Use the official correction or shift workflow so your roll entry matches your current residence.",
        ["Confirm whether the move is within the same AC.",
         "Prepare current address proof.",
         "Submit {form_8} or the official shift workflow.",
         "Verify your updated polling station after disposal."],
        ["@address", "Existing voter reference"],
    ),
    "correction": (
        "medium", "Correct voter details",
        "Use {form_8} for spelling, age, address, replacement EPIC, or similar corrections.",
        ["Identify the incorrect field.",
         "Prepare supporting proof.",
         "Submit {form_8} and track the request."],
        ["Existing voter reference", "@correction"],
    ),
    "deceased_family": (
        "medium", "Report a deceased family member entry",
        "Use the official objection or deletion route only with supporting details and documents.",
        ["Confirm the entry in the current roll.",
         "Prepare available supporting record for the deceased elector.",
         "Submit {form_7} or contact the local ERO/BLO route.",
         "Keep acknowledgement details for follow-up."],
        ["Supporting record for deletion request", "Your contact details for official follow-up"],
    ),
    "duplicate_entry": (
        "medium", "Report or resolve duplicate entries",
        "Duplicate entries should be corrected through official ERO/BLO channels so the valid entry is retained.",
        ["Note both duplicate entries without sharing them publicly.",
         "Contact the BLO or ERO and ask which entry should remain active.",
         "Submit the official objection or correction form if instructed."],
        ["Existing voter reference", "@address"],
    ),
    "portal_failed": (
        "high", "Use offline fallback if the portal fails",
        "Portal issues should not block SIR action. Contact BLO or ERO before the deadline.",
        ["Retry the official portal once.",
         "Record the error without sharing private details publicly.",
         "Submit the relevant form offline and keep acknowledgement."],
        ["Relevant form details", "Identity proof", "Address proof"],
    ),
}
