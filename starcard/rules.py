"""Fixed values the results depend on: word lists, name patterns, thresholds and defaults."""

from __future__ import annotations

# --- fixed values: value maps -------------------------------------------------------------------
FULL_MAP_ROWS = 500
SAMPLED_ROWS = 20
LOOKUP_SCHEMA = "ICSR_LOOKUP"

# --- fixed values: key and label columns of a lookup --------------------------------------------
KEY_NAMES = ["ID", "CODE"]
KEY_SUFFIXES = ["_CODE", "_ID"]
LABEL_NAMES = ["NAME", "LABEL", "DESCRIPTION", "DESC", "TITLE"]
LABEL_SUFFIXES = ["_NAME", "_DESC"]

# --- fixed values: tables left out of the catalog -----------------------------------------------
# (kind, pattern, schema); a null schema means every schema
SKIP_RULES = [
    ("keep", "DD_SAFETYREPORT_DUPLICATES", None),
    ("prefix", "TMP_", None),
    ("prefix", "DD_", None),
    ("prefix", "DDC_", None),
    ("prefix", "QRTZ_", None),
    ("prefix", "CT_", None),
    ("prefix", "MODEL_", None),
    ("prefix", "INTERPRETATION_", None),
    ("prefix", "REROUTED_MESSAGE", None),
    ("prefix", "EXPORT_REQUEST", None),
    ("prefix", "VW_R_AUTO_LOG", None),
    ("suffix", "_RECODE", None),
    ("suffix", "_TMP", None),
    ("suffix", "_HIST", "ICSR_EMA"),
    ("suffix", "_LOG", None),
    ("contains", "_BK_", None),
    ("contains", "_BAK", None),
    ("exact", "MAP_TBL_COL", None),
    ("exact", "MAP_TBL_SEQ", None),
    ("exact", "TBL_STATS_EXPORT", None),
    ("exact", "UNIT_MISSPELLING", None),
    ("exact", "CONFIG_PARAMETER", None),
    ("exact", "QUALITY_ISSUE", None),
    ("exact", "CRITERIA", None),
    ("exact", "SCHEMA_VERSION", None),
    ("exact", "TMP_REPORTER", "ICSR"),
    ("exact", "ACCESS_LEVEL", "ICSR_LOOKUP"),
    ("exact", "ACCESS_RIGHT", "ICSR_LOOKUP"),
    ("exact", "ACCESS_POLICY", "ICSR_EMA"),
    ("exact", "ACCESS_LEVEL_ICSR_FIELD", "ICSR_EMA"),
    ("exact", "ROLE_ACCESS_RIGHT", "ICSR_EMA"),
    ("exact", "L2B_ACCESS_LOG", "ICSR_EMA"),
    ("exact", "MESSAGE_EXCHANGE", "ICSR_EMA"),
    ("exact", "MESSAGE_AUDITING", "ICSR_EMA"),
    ("exact", "MESSAGING_QUEUE_SUPPORT", "ICSR_EMA"),
    ("exact", "ORGANISATION_REROUTING", "ICSR_EMA"),
    ("exact", "NCA_REROUTING_COUNTRY", "ICSR_EMA"),
    ("exact", "NCA_SUSAR_REROUTING_COUNTRY", "ICSR_EMA"),
    ("exact", "NCA_SUSAR_ROUTING_COUNTRY", "ICSR_EMA"),
    ("exact", "REPORT_CATEGORY_ORG", "ICSR_EMA"),
    ("exact", "APP_COMPONENT_DOWNTIME", "ICSR_EMA"),
    ("exact", "DOCUMENT_DMS_MAPPING", "ICSR_EMA"),
    ("exact", "DM_CONFIGURATION", "ICSR_EMA"),
    ("exact", "DM_MAPPING", "ICSR_EMA"),
    ("exact", "DM_EXTERNAL_DATA", "ICSR_EMA"),
    ("exact", "D_PROCEDURERESULTS", "ICSR_EMA"),
    ("exact", "R_STATUS_PRODS", "ICSR_EMA"),
    ("exact", "R_STATUS_SUBS", "ICSR_EMA"),
    ("exact", "ICSR_FIELD_NULL_FLAVOUR", "ICSR_EMA"),
    ("exact", "ICSR_FIELD_OID", "ICSR_EMA"),
    ("exact", "VW_ORGANISATION_HQ", "ICSR_EMA"),
    ("exact", "VW_REPORTS_MLM", "ICSR_EMA"),
    ("exact", "VW_SUBSTANCES_MLM", "ICSR_EMA"),
    ("exact", "ACTIVE_SUBSTANCE_MLM", "ICSR_EMA"),
    ("exact", "SAFETY_REPORT_COMMIT_ROLLBACK", "ICSR_EMA"),
]

# --- fixed values: system tables of the source database (LIKE patterns, "_" is a wildcard) ------
SYSTEM_TABLE_PATTERNS = ["DR$%", "BIN$%", "MLOG$%", "RUPD$%", "ZZ_%", "RV$%"]

# --- fixed values: column name tokens without meaning at the end of a name ----------------------
NOISE_TOKENS = ["id", "code", "key", "num", "pk", "fk", "flag", "ind"]

# --- fixed values: characters not allowed in a document id --------------------------------------
ID_UNSAFE = "$./\\#?"

# --- fixed values: schema names -----------------------------------------------------------------
SCHEMA_NAME = r"^[A-Za-z][A-Za-z0-9_]*\z"

# --- fixed values: source types and their affinity, first match wins ----------------------------
PARAMETRIC_NUMBER = r"^(?:NUMBER|DECIMAL|NUMERIC)\((\d+)(?:,\s*(\d+))?\)"
TYPE_PREFIXES = [
    (["INTEGER", "INT", "SMALLINT", "TINYINT", "BIGINT"], "INTEGER"),
    (["FLOAT", "DOUBLE", "REAL", "BINARY_FLOAT", "BINARY_DOUBLE"], "REAL"),
    (["BLOB", "LONG RAW", "RAW", "VARBINARY", "BINARY"], "BLOB"),
    (["CHAR", "VARCHAR", "NCHAR", "NVARCHAR", "CLOB", "NCLOB", "LONG"], "TEXT"),
    (["DATE", "TIMESTAMP"], "TEXT"),
]
SIZED_CHAR_TYPES = ["VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR"]

# --- fixed values: search and expansion defaults ------------------------------------------------
TOP_K = 50
CORE_COUNT = 10
SEED_COUNT = 3
MAX_TOTAL = 25
CORE_TABLES = ["ICSR.SAFETY_REPORT", "ICSR.PATIENT", "ICSR.DRUG", "ICSR.REACTION"]
NOISE_VALUE_MAPS = ["NULL_FLAVOUR", "DATE_PRECISION", "NULLFLAVOR"]

# --- fixed values: runs -------------------------------------------------------------------------
MAX_REPAIR_ATTEMPTS = 1
RUN_FIELDS = [
    "run_id", "timestamp", "user_query", "sql", "sql_dialect", "sql_rationale", "tables_used",
    "deployment_name",
]
RUN_FILE = "run_%05d.json"

# --- fixed values: texts of a blocked run's result ----------------------------------------------
BLOCKED_PREFIX = "Validation failed: "
BLOCKED_WITHOUT_DETAIL = "Validation failed (no details available)"

# --- fixed values: ranking constants from the literature (not published by the service) ---------
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
]
TOKEN = r"[\p{L}\p{N}]+"

# --- fixed values: size classes of a table ------------------------------------------------------
FACT_ROWS = 1_000_000
LOOKUP_ROWS = 1_000
