"""Domain constants.

Fixed values that must equal the reference application's for right results
(enumerations, bucket codes and labels, metric catalogue, export field lists,
report texts). They are stated here once, in their natural order.
"""

from __future__ import annotations

# --- fixed values: enumerations ---------------------------------------------
STATUSES = ("OPEN", "CLOSED", "SOLVED", "NEW", "PENDING", "HOLD")
PRIORITIES = ("URGENT", "HIGH", "NORMAL", "LOW")
SCORES = ("GOOD", "BAD", "UNOFFERED", "OFFERED")
RESOLVED_STATUSES = ("SOLVED", "CLOSED")
RATED_SCORES = ("GOOD", "BAD")

# Canonical display order of priorities (others sort last).
PRIORITY_DISPLAY_ORDER = ("URGENT", "HIGH", "NORMAL", "LOW")

# --- fixed values: first-response buckets (code, label, upper bound seconds) -
RESPONSE_BUCKETS = (
    ("up_to_15m", "Até 15 min", 15 * 60),
    ("15_to_30m", "15 a 30 min", 30 * 60),
    ("30_to_60m", "30 a 60 min", 60 * 60),
    ("1_to_4h", "1 a 4 h", 4 * 60 * 60),
    ("over_4h", "Acima de 4 h", None),
    ("unanswered", "Sem resposta válida", None),
)

# --- fixed values: metric catalogue (code, label, unit) ---------------------
METRICS = (
    ("ticket_volume", "Volume de tickets", "tickets"),
    ("average_recurrence_seconds", "Frequência média", "seconds"),
    ("top_topics", "Assuntos principais", "tickets"),
    ("resolution_rate", "Taxa de resolução", "ratio"),
    ("satisfaction_rate", "Índice de satisfação", "ratio"),
    ("average_first_response_seconds", "Tempo médio até a primeira resposta", "seconds"),
)
METRIC_CODES = tuple(code for code, _, _ in METRICS)
# order in which the metric export writes its rows (topics last)
METRIC_EXPORT_ORDER = (
    "ticket_volume",
    "average_recurrence_seconds",
    "resolution_rate",
    "satisfaction_rate",
    "average_first_response_seconds",
    "top_topics",
)
METRIC_LABELS = {code: label for code, label, _ in METRICS}
METRIC_UNITS = {code: unit for code, _, unit in METRICS}

# --- fixed values: metric export columns -----------------------------------
OVERALL_SCOPE_ID = "all"
OVERALL_SCOPE_LABEL = "Visão geral"

# --- fixed values: data export fields and presets --------------------------
EXPORT_FIELDS = (
    "ticket_id",
    "subject",
    "description",
    "status",
    "priority",
    "requester_id",
    "requester_name",
    "requester_email",
    "assignee_id",
    "assignee_name",
    "created_at",
    "updated_at",
    "first_response_at",
    "tags",
    "satisfaction_rating",
)
ESSENTIAL_EXPORT_FIELDS = (
    "ticket_id",
    "subject",
    "status",
    "priority",
    "requester_name",
    "assignee_name",
    "created_at",
    "first_response_at",
    "tags",
    "satisfaction_rating",
)
SERVICE_EXPORT_FIELDS = (
    "ticket_id",
    "subject",
    "description",
    "status",
    "priority",
    "requester_name",
    "requester_email",
    "assignee_name",
    "created_at",
    "updated_at",
    "first_response_at",
    "tags",
    "satisfaction_rating",
)
EXPORT_PRESETS = {
    "essential": ESSENTIAL_EXPORT_FIELDS,
    "service": SERVICE_EXPORT_FIELDS,
    "complete": EXPORT_FIELDS,
}

# --- fixed values: spreadsheet formula guard -------------------------------
FORMULA_PREFIXES = ("=", "+", "-", "@")

# --- fixed values: report names and fallbacks ------------------------------
DEFAULT_SHEET_NAME = "Relatorio"
ASSIGNEE_FALLBACK_PREFIX = "Responsável "
SUMMARY_NO_BASE = "O período não possui uma base anterior comparável."
SUMMARY_NO_ALERT = "Nenhuma deterioração relevante foi detectada."
SUMMARY_NO_IMPROVEMENT = "Nenhuma melhora relevante foi detectada."

# --- fixed values: narrative summary texts (D13) ----------------------------
# without a base, unchanged, risen, fallen; {} is the change with one decimal
HEADLINE_VOLUME = ("O volume não tem base anterior comparável.", "O volume permaneceu estável.",
                   "O volume aumentou {}%.", "O volume caiu {}%.")
HEADLINE_RESOLUTION = ("A taxa de resolução não tem base anterior comparável.", "A taxa de resolução permaneceu estável.",
                       "A taxa de resolução subiu {} p.p.", "A taxa de resolução caiu {} p.p.")
HEADLINE_FIRST_RESPONSE = ("O tempo médio até a primeira resposta não tem base anterior comparável.",
                           "O tempo médio até a primeira resposta permaneceu estável.",
                           "O tempo médio até a primeira resposta ficou {}% mais lento.",
                           "O tempo médio até a primeira resposta ficou {}% mais rápido.")
# risen, otherwise
ALERT_RESOLUTION = ("Resolução subiu {} p.p.", "Resolução caiu {} p.p.")
ALERT_FIRST_RESPONSE = ("Primeira resposta ficou {}% mais lenta.", "Primeira resposta ficou {}% mais rápida.")
ALERT_SATISFACTION = ("Satisfação subiu {} p.p.", "Satisfação caiu {} p.p.")
STABLE_THRESHOLD = 0.05

# --- fixed values: period presets (days back from now) ---------------------
DASHBOARD_PERIODS = {"today": 0, "7d": 7, "30d": 30, "90d": 90, "custom": None}
EXPORT_PERIODS = {"7d": 7, "30d": 30, "90d": 90, "all": None, "custom": None}

# --- fixed values: argument limits -----------------------------------------
TOP_TOPICS_LIMIT = (1, 50, 10)       # min, max, default (dashboard, exports)
TIMELINE_LIMIT = (1, 366, 90)
SEARCH_MAX_TERMS = 10
TOP_CUSTOMERS = 5

# --- fixed values: ingestion validation ------------------------------------
SUBJECT_MAX = 500
NAME_MAX = 255
EMAIL_MIN, EMAIL_MAX = 3, 255
COMMENT_MAX = 1000
