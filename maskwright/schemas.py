"""Shapes of the tables that operators pass on, and the PHI dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id string, patient_id string, record_id string, sys_id string, text string"
SPANS = "doc_id string, sys_id string, ord int, id string, tag_name string, tag_type string, start int, end int, text string, comment string"
TOKENS = "doc_id string, sent_idx int, tok_idx int, text string, type string, start int, end int"
RISK_TAGS = SPANS + ", time string, indicator string, status string, type1 string, type2 string"

# Every PHI type with its category.
PHI_TYPES = {
    "PATIENT": "NAME", "DOCTOR": "NAME", "USERNAME": "NAME",
    "PROFESSION": "PROFESSION",
    "ROOM": "LOCATION", "DEPARTMENT": "LOCATION", "HOSPITAL": "LOCATION", "ORGANIZATION": "LOCATION", "STREET": "LOCATION", "CITY": "LOCATION",
    "STATE": "LOCATION", "COUNTRY": "LOCATION", "ZIP": "LOCATION", "LOCATION-OTHER": "LOCATION",
    "AGE": "AGE",
    "DATE": "DATE",
    "PHONE": "CONTACT", "FAX": "CONTACT", "EMAIL": "CONTACT", "URL": "CONTACT", "IPADDR": "CONTACT",
    "SSN": "ID", "MEDICALRECORD": "ID", "HEALTHPLAN": "ID", "ACCOUNT": "ID", "LICENSE": "ID", "VEHICLE": "ID", "DEVICE": "ID", "BIOID": "ID", "IDNUM": "ID",
    "OTHER": "OTHER",
}
# The types that HIPAA protects.  IDNUM is not among them unless asked for.
HIPAA_TYPES = (
    "PATIENT", "CITY", "STREET", "ZIP", "ORGANIZATION", "DATE", "PHONE", "FAX", "EMAIL", "SSN", "MEDICALRECORD", "HEALTHPLAN", "ACCOUNT", "LICENSE",
    "VEHICLE", "DEVICE", "BIOID", "AGE",
)
CATEGORIES = ("NAME", "PROFESSION", "LOCATION", "AGE", "DATE", "CONTACT", "ID", "OTHER")
BINARY_TYPE = "PATIENT"
SENTINELS = ("<s>", "</s>")
UNKNOWN_WORD = "<unk>"


def phi_types(spark: SparkSession, hipaa_idnum: bool = False) -> DataFrame:
    """(tag_type, tag_name, is_hipaa): 31 rows, so joins with it may broadcast."""
    protected = {*HIPAA_TYPES, *(["IDNUM"] if hipaa_idnum else [])}
    return spark.createDataFrame([(t, n, t in protected) for t, n in PHI_TYPES.items()], "tag_type string, tag_name string, is_hipaa boolean")


def labels(hipaa_only: bool = False, binary: bool = False, hipaa_idnum: bool = False) -> list[str]:
    """Label vocabulary by index: padding and outside are both O, then the B- and I- labels in alphabetical order."""
    types = [BINARY_TYPE] if binary else [t for t in PHI_TYPES if not hipaa_only or t in HIPAA_TYPES or (hipaa_idnum and t == "IDNUM")]
    return ["O", "O", *sorted(f"{p}-{t}" for t in types for p in "BI")]


def label_index(spark: SparkSession, **which: bool) -> DataFrame:
    """(ind, label); O has index 1 and never 0, which is padding."""
    return spark.createDataFrame(list(enumerate(labels(**which))), "ind int, label string")
