"""Limits, prices, word lists and patterns that decide results."""

# Physical limits per metric: unit, lowest and highest possible reading.
PHYSICAL_RANGES = {
    "current_draw": ("A", -60.0, 150.0),
    "pack_voltage": ("V", 30.0, 60.0),
    "motor_temp": ("C", -30.0, 160.0),
    "ambient_temp": ("C", -30.0, 60.0),
    "speed": ("km/h", 0.0, 130.0),
    "state_of_charge": ("%", 0.0, 100.0),
    "cell_health": ("%", 0.0, 100.0),
    "payload": ("kg", 0.0, 350.0),
    "range_estimate": ("km", 0.0, 400.0),
    "charge_power": ("kW", 0.0, 5.0),
}

# US dollars per million tokens: input, output.
PRICES = {
    "gpt-oss-120b": (0.15, 0.60),
    "gpt-oss-20b": (0.075, 0.30),
    "qwen3.8-27b": (0.29, 0.59),
}

# Column synonyms of a comparison row, in order of preference.
ACTUAL_COLUMNS = ["actual", "actual_value", "observed", "measured", "avg_value", "avg_actual"]

DEFAULT_TOLERANCE_PCT = 10.0
TIME_ZONE = "Asia/Kolkata"

# Search settings.
CANDIDATE_K = 50
RERANK_CANDIDATES = 10
FINAL_K = 5
RRF_K = 60
DENSE_WEIGHT = 0.6
SPARSE_WEIGHT = 0.4
ENTITY_BOOST = 0.15
RERANK_SKIP_MARGIN = 0.25
CONFIDENCE_THRESHOLD = 0.30

# The English stop words of keyword search.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now"
).split()

# Identifier matching.
AUTO_ACCEPT_SCORE = 92.0
DISAMBIGUATE_SCORE = 78.0
MAX_SUGGESTIONS = 3
TRIGRAM_THRESHOLD = 0.2
MAX_CANDIDATES = 50

# Rephrase detection.
REPHRASE_WINDOW_S = 30
REPHRASE_SIMILARITY = 55.0
SLOW_MS = 20000
MAX_CASES_PER_CLUSTER = 3
SIMILAR_CASE = 85.0

# Failure clusters, most specific first.
CLUSTER_ORDER = [
    "wrong_domain", "wrong_tool", "step_failed", "sql_failed", "empty_retrieval",
    "grounding_failure", "hit_limit", "slow", "no_signal",
]

# Histogram bucket bounds.
LATENCY_BUCKETS = [1.0, 2.5, 5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0]

# Chunking sizes, in characters.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
CAPTION_CHARS = 300

ERROR_CODE_PATTERN = r"\b[A-Z]{2,5}_\d{2,4}\b"
LOOKUP_KEY_PATTERN = r"^[A-Z][A-Z0-9]*(?:[-_][A-Z0-9]+)+$"

# Header spellings of a code table and the column each one fills.
CODE_COLUMNS = {
    "code": "code", "error_code": "code", "dtc": "code", "trouble_code": "code",
    "subsystem": "subsystem", "system": "subsystem", "component": "subsystem",
    "meaning": "meaning", "description": "meaning",
    "recommended_action": "recommended_action", "action": "recommended_action",
    "severity": "severity", "level": "severity",
}

# One number per match, by quantity; case is ignored.
FACT_PATTERNS = {
    "battery_kwh": r"(\d+(?:\.\d+)?)\s?kWh",
    "range_km": r"(\d{2,3})\s?(?:km|kms|kilometres|kilometers)\b(?:\s(?:of\s)?(?:range|IDC|certified|claimed|per charge|/charge))",
    "top_speed_kmph": r"(\d{2,3})\s?(?:km/h|kmph|kph)",
    "motor_kw": r"(\d+(?:\.\d+)?)\s?kW\b",
    "torque_nm": r"(\d{2,3})\s?Nm\b",
    "weight_kg": r"(\d{2,3})\s?kg\b",
    "price_inr": r"(?:Rs\.?|₹|INR)\s?([\d,]{5,9})",
    "units_sold": r"([\d,]{3,7})\s?units",
}

# Page furniture: lines that carry no content.
FURNITURE_PATTERN = (
    r"^(\d+\s*min(\s*read)?|read more:.*|share|table of contents|faqs?|"
    r"frequently asked questions|home|blogs?)$"
)

STOPWORDS = """a an and are as at be but by can do does for from how i if in is it its
of on or so that the their them then there these this to was what when where which who why
will with would you your my me we our any all has have had not no than too very just""".split()

# Words that state a cause, and words that excuse one in the same clause.
CAUSAL_MARKERS = [
    "because", "due to", "caused by", "the cause is", "results from", "resulting in",
    "resulted in", "results in", "leads to", "led to", "leading to", "responsible for",
    "attributable to", "attributed to", "stems from", "driven by", "triggered by",
    "the reason is", "the reason for", "is why", "as a result",
]
CAUSAL_EXEMPT = [
    "cannot", "can't", "could not", "couldn't", "unable", "not established",
    "no documentation", "no document", "no bulletin", "not documented", "no evidence",
    "no data", "not confirmed", "not determined", "unknown", "insufficient", "ruled out",
    "rules out",
]
CONTRAST_WORDS = ["but", "although", "though", "whereas", "while", "however", "yet"]
NUMERIC_TOLERANCE_PCT = 1.0
IGNORE_INTEGERS_BELOW = 10

# Phrases of an honest "I cannot tell".
ABSTAIN_MARKERS = [
    "cannot", "can't", "could not", "couldn't", "unable", "no data", "not found",
    "does not exist", "doesn't exist", "no vehicle", "no such", "no record",
    "no document", "no documentation", "not available", "not in the", "no information",
    "not recorded", "not determine", "not be determined", "undetermined", "unknown",
    "no evidence", "not covered", "isn't covered", "not provided", "no usable",
]

FAILURE_STOP_REASONS = ["cap_reached", "timeout", "no_new_evidence"]
HANDWRITTEN_SOURCES = ["adversarial", "promoted"]
TRUST_LEVELS = ["official", "internal", "external"]
DOMAINS = ["diagnostic", "business"]
