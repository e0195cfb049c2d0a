"""Entity types and their fixed properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of each entity type (any other type is CUSTOM).
CATEGORIES = {
    "SECRET": ("CONNECTION_STRING", "API_KEY", "JWT_TOKEN", "PASSWORD", "SOURCE_CODE_SECRET", "COMPANY_SECRET"),
    "PII": ("EMAIL_ADDRESS", "PHONE_NUMBER", "PERSON_NAME", "SSN_NATIONAL_ID", "PASSPORT_NUMBER", "ADDRESS", "DATE"),
    "FINANCIAL": ("CREDIT_CARD", "BANK_ACCOUNT", "IBAN", "FINANCIAL_METRIC"),
    "IDENTIFIER": ("EMPLOYEE_ID", "CUSTOMER_ID", "UUID"),
    "MEDICAL": ("MEDICAL_RECORD",),
    "LEGAL": ("LEGAL_REFERENCE",),
    "CONTEXTUAL": ("PROJECT_CODENAME", "ORGANIZATION", "REPOSITORY", "LOCATION", "PRODUCT", "EVENT", "URL"),
}
# How specific a type is, when one value was found as several.
SPECIFICITY = {
    "API_KEY": 100, "JWT_TOKEN": 95, "CONNECTION_STRING": 95, "CREDIT_CARD": 90, "IBAN": 90, "SSN_NATIONAL_ID": 90,
    "EMAIL_ADDRESS": 85, "IP_ADDRESS": 85, "PHONE_NUMBER": 85, "BANK_ACCOUNT": 85, "PASSPORT_NUMBER": 85, "UUID": 80, "URL": 75,
    "SOURCE_CODE_SECRET": 70, "COMPANY_SECRET": 70, "PASSWORD": 65, "PERSON_NAME": 50, "PROJECT_CODENAME": 50, "EMPLOYEE_ID": 50,
    "CUSTOMER_ID": 50, "MEDICAL_RECORD": 50, "LEGAL_REFERENCE": 50, "FINANCIAL_METRIC": 50, "ORGANIZATION": 45, "REPOSITORY": 45,
    "LOCATION": 40, "PRODUCT": 40, "EVENT": 40, "ADDRESS": 40, "DATE": 35, "CUSTOM_TERM": 30,
}
UNKNOWN_SPECIFICITY = 50
# Types whose spans take in the spans inside them.
CONTAINERS = (
    "EMAIL_ADDRESS", "CONNECTION_STRING", "URL", "API_KEY", "JWT_TOKEN", "PASSWORD", "SOURCE_CODE_SECRET", "COMPANY_SECRET",
    "CREDIT_CARD", "IBAN", "PHONE_NUMBER",
)
# Types that merge when they overlap (each type also with itself).
COMPATIBLE = (
    ("URL", "CONNECTION_STRING"), ("CONNECTION_STRING", "PASSWORD"), ("CONNECTION_STRING", "API_KEY"), ("JWT_TOKEN", "API_KEY"),
    ("JWT_TOKEN", "SOURCE_CODE_SECRET"), ("API_KEY", "SOURCE_CODE_SECRET"), ("CUSTOM_TERM", "PROJECT_CODENAME"), ("CUSTOM_TERM", "ORGANIZATION"),
)
# Types whose values are looked for again in the whole document.
PROPAGATED = (
    "PERSON_NAME", "PROJECT_CODENAME", "ORGANIZATION", "REPOSITORY", "EMAIL_ADDRESS", "PHONE_NUMBER", "API_KEY", "PASSWORD", "JWT_TOKEN",
    "CONNECTION_STRING", "SSN_NATIONAL_ID", "CREDIT_CARD", "BANK_ACCOUNT", "IBAN", "EMPLOYEE_ID", "CUSTOMER_ID", "CUSTOM_TERM", "PRODUCT",
)
# Priorities of detectors.
SECRET_PRIORITY, REGEX_PRIORITY, DICTIONARY_PRIORITY, NAME_PRIORITY, CONTEXT_PRIORITY = 95, 90, 80, 75, 70
#: A user's own choice wins over every rule.
MANUAL_PRIORITY = 1000

#: One found value: [start, end) in characters, and where it comes from. seq orders ties.
SPAN = "struct<start:int,end:int,entity_type:string,confidence:double,priority:int,detector:string,evidence:string,text:string,prefix:string,seq:int>"


def category_of(entity_type: Column) -> Column:
    out = F.lit("CUSTOM")
    for category, types in CATEGORIES.items():
        out = F.when(entity_type.isin(*types), category).otherwise(out)
    return out


def specificity_of(entity_type: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SPECIFICITY.items() for x in pair])
    return F.coalesce(ranks[entity_type], F.lit(UNKNOWN_SPECIFICITY))


def is_container(entity_type: Column) -> Column:
    return entity_type.isin(*CONTAINERS)


def are_compatible(a: Column, b: Column, pairs: tuple[tuple[str, str], ...] = COMPATIBLE) -> Column:
    out = a == b
    for x, y in pairs:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out
