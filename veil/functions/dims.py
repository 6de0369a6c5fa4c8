"""Fixed values of the sensitive-data model: types, priorities, strategies, categories, frameworks.

Everything here has a constant size, so lookups are constant maps rather than joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: type priority (a type that is not listed has priority 0) ---
PRIORITY = {
    "SSN": 100,
    "CREDIT_CARD": 95,
    "BANK_ACCOUNT": 95,
    "AADHAAR": 90,
    "PAN": 90,
    "PASSPORT": 85,
    "DRIVER_LICENSE": 85,
    "MEDICAL_RECORD": 80,
    "INSURANCE_ID": 80,
    "EMPLOYEE_ID": 75,
    "STUDENT_ID": 75,
    "VACCINE_LOT": 70,
    "TRACKING_NUMBER": 70,
    "RECEIPT_NUMBER": 70,
    "VOLUNTEER_CODE": 70,
    "BARCODE": 65,
    "VEHICLE_PLATE": 65,
    "MAC_ADDRESS": 60,
    "IP_ADDRESS": 60,
    "URL": 55,
    "COORDINATES": 55,
    "EMAIL": 50,
    "PHONE": 50,
    "DATE_OF_BIRTH": 45,
    "DATE": 40,
    "ADDRESS": 35,
    "ZIP_CODE": 35,
    "PERSON": 30,
    "ORG": 25,
    "LOC": 20,
    "MISC": 10,
}

# --- fixed values: suggested strategy (anything else is redacted) ---
STRATEGY = {
    "SSN": "redact",
    "CREDIT_CARD": "redact",
    "BANK_ACCOUNT": "redact",
    "AADHAAR": "redact",
    "PERSON": "pseudo",
    "ORG": "pseudo",
    "ADDRESS": "pseudo",
    "LOC": "pseudo",
    "EMAIL": "mask",
    "PHONE": "mask",
    "DATE_OF_BIRTH": "mask",
    "DATE": "mask",
}

# --- fixed values: severity, exact-type rule and name-fragment rule ---
HIGH_TYPES = ["SSN", "CREDIT_CARD", "BANK_ACCOUNT", "AADHAAR", "PASSPORT"]
MEDIUM_TYPES = ["PHONE", "EMAIL", "DATE_OF_BIRTH", "DRIVER_LICENSE"]
HIGH_FRAGMENTS = ["ssn", "credit_card", "passport", "driver_license"]
MEDIUM_FRAGMENTS = ["phone", "email", "address", "date_of_birth"]

# --- fixed values: review categories (anything else is "others") ---
CATEGORIES = ["person", "locationAddress", "codes", "identityCards", "others"]
CATEGORY = {
    "PERSON": "person",
    "ADDRESS": "locationAddress",
    "LOC": "locationAddress",
    "COORDINATES": "locationAddress",
    "ZIP_CODE": "codes",
    "MAC_ADDRESS": "codes",
    "IP_ADDRESS": "codes",
    "VEHICLE_PLATE": "codes",
    "BARCODE": "codes",
    "VOLUNTEER_CODE": "codes",
    "RECEIPT_NUMBER": "codes",
    "TRACKING_NUMBER": "codes",
    "URL": "codes",
    "VACCINE_LOT": "codes",
    "EMPLOYEE_ID": "identityCards",
    "STUDENT_ID": "identityCards",
    "PASSPORT": "identityCards",
    "DRIVER_LICENSE": "identityCards",
    "SSN": "identityCards",
    "PAN": "identityCards",
    "AADHAAR": "identityCards",
    "INSURANCE_ID": "identityCards",
    "MEDICAL_RECORD": "identityCards",
}

# --- fixed values: display labels (a type that is not listed shows as itself) ---
LABEL = {
    "PERSON": "Person Name",
    "ORG": "Organization",
    "LOC": "Location",
    "EMAIL": "Email Address",
    "PHONE": "Phone Number",
    "SSN": "Social Security Number",
    "CREDIT_CARD": "Credit Card",
    "DATE_OF_BIRTH": "Date of Birth",
    "ADDRESS": "Address",
    "PASSPORT": "Passport Number",
    "DRIVER_LICENSE": "Driver License",
    "BANK_ACCOUNT": "Bank Account",
}

# --- fixed values: types each compliance framework covers ---
FRAMEWORKS = {
    "HIPAA": [
        "PERSON", "SSN", "MEDICAL_RECORD", "INSURANCE_ID", "BANK_ACCOUNT", "DRIVER_LICENSE",
        "MAC_ADDRESS", "IP_ADDRESS", "DATE_OF_BIRTH", "DATE", "ADDRESS", "ZIP_CODE", "LOC",
        "EMAIL", "URL", "PHONE",
    ],
    "GDPR": [
        "PERSON", "ADDRESS", "EMAIL", "PASSPORT", "DRIVER_LICENSE", "LOC", "COORDINATES",
        "IP_ADDRESS",
    ],
    "DPDPA": [
        "PERSON", "PHONE", "EMAIL", "AADHAAR", "PAN", "PASSPORT", "DRIVER_LICENSE",
        "BANK_ACCOUNT", "CREDIT_CARD", "LOC", "COORDINATES", "IP_ADDRESS", "MAC_ADDRESS",
        "MEDICAL_RECORD", "STUDENT_ID", "EMPLOYEE_ID",
    ],
    "GLBA": [
        "SSN", "BANK_ACCOUNT", "PERSON", "ADDRESS", "PHONE", "EMAIL", "INSURANCE_ID",
        "EMPLOYEE_ID", "PAN", "DRIVER_LICENSE", "PASSPORT",
    ],
}

# --- fixed values: model-recognizer labels and the words it must not report ---
NER_LABELS = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOC", "MISC": "MISC"}
NER_STOP_WORDS = (
    "we in ad co or a e x c h z management investment service product products advisor custom "
    "level face pan act boom us new state american america"
).split()

# --- fixed values: words that are not proper nouns ---
NOUN_STOP_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his how its may "
    "new now old see two way who boy did let put say she too use"
).split()

# --- fixed values: column labels and subtypes ---
COLUMN_LABELS = ["PII", "PHI", "NONE"]
COLUMN_SUBTYPES = [
    "name", "email", "phone", "ssn", "national_id", "address", "date_of_birth",
    "medical_condition", "medical_record_number", "account_number", "generic_id", "other",
]


def case_lookup(key: Column, table: dict, default: Column) -> Column:
    """Value of a constant table; the map literal is folded once per plan."""
    pairs = ", ".join(f"'{k}', {v!r}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), default)


def normalize_type(pii_type: Column) -> Column:
    """ORGANISATIONS is the prompt's spelling of ORG."""
    return F.when(pii_type == "ORGANISATIONS", F.lit("ORG")).otherwise(pii_type)


def suggest_strategy(pii_type: Column) -> Column:
    return case_lookup(pii_type, STRATEGY, F.lit("redact"))


def type_priority(pii_type: Column) -> Column:
    return case_lookup(pii_type, PRIORITY, F.lit(0))


def severity_single(pii_type: Column) -> Column:
    return (
        F.when(pii_type.isin(HIGH_TYPES), F.lit("high"))
        .when(pii_type.isin(MEDIUM_TYPES), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity_bulk(pii_type: Column) -> Column:
    name = F.lower(pii_type)
    return (
        F.when(name.rlike("|".join(HIGH_FRAGMENTS)), F.lit("high"))
        .when(name.rlike("|".join(MEDIUM_FRAGMENTS)), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def category(pii_type: Column) -> Column:
    return case_lookup(pii_type, CATEGORY, F.lit("others"))


def display_name(pii_type: Column) -> Column:
    return case_lookup(pii_type, LABEL, pii_type)


def location(page_num: Column) -> Column:
    return F.concat(F.lit("Page "), (page_num + 1).cast("string"))


def framework_rows(spark):
    """(framework, pii_type) as a DataFrame: 51 rows, constant size."""
    rows = [(fw, t) for fw, types in FRAMEWORKS.items() for t in types]
    return spark.createDataFrame(rows, "framework string, pii_type string")


def category_rows(spark):
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
