"""Word lists, patterns, prices and thresholds that results depend on."""

# Texts that a reader treats as missing.
NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "None", "#N/A", "NaN"]

# Formats tried in turn by the lenient datetime parser.
DATETIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
]

# Substrings of column names that hint at a semantic type.
EMAIL_WORDS = ["email", "e_mail", "mail", "contact"]
PHONE_WORDS = ["phone", "tel", "mobile", "cell", "fax", "contact_no"]
PERCENT_WORDS = [
    "%", "pct", "percent", "rate", "ratio", "share", "fraction", "completion", "discount", "margin",
]
CURRENCY_WORDS = [
    "price", "revenue", "cost", "amount", "salary", "fee", "total", "subtotal", "tax", "income",
    "spend", "budget", "payment", "charge", "earnings", "profit", "margin", "sales",
    "usd", "eur", "gbp", "jpy", "$", "£", "€",
]
COUNT_WORDS = [
    "count", "qty", "quantity", "num_", "n_", "items", "units", "orders", "transactions",
    "visits", "clicks", "views", "sessions", "users", "customers",
]
ID_WORDS = ["_id", "id", "_key", "uuid", "guid", "pk", "fk", "code", "ref"]
DATE_WORDS = [
    "date", "day", "month", "year", "dt", "timestamp", "time", "created_at", "updated_at",
    "deleted_at", "start", "end", "opened", "closed", "published", "birth", "hired",
]

# Personal-data patterns, in the order the redactions are applied.
PII_PATTERNS = [
    ("email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("phone_us", r"\b(?:\+1[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("phone_intl", r"\+\d{1,3}[\s-]?\d{4,14}\b"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("name_title", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"),
    ("street_addr", r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+(?:St|Ave|Rd|Blvd|Dr|Ln|Way|Ct|Pl)\.?)"),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}\b"),
]

# Prompt-injection categories with weight and patterns (all case-insensitive).
INJECTION_PATTERNS = [
    ("persona_override", 2.0, [
        r"\bignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)",
        r"\bforget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)",
        r"\byou\s+are\s+now\s+(a|an)\s+\w+",
        r"\bact\s+as\s+(a|an)\s+(different|new|unrestricted|free)",
        r"\bpretend\s+(you\s+are|to\s+be)\s+(a|an)\s+\w+",
    ]),
    ("system_prompt_extraction", 2.0, [
        r"\b(repeat|print|output|reveal|show|display|tell\s+me)\s+(your\s+)?(system\s+prompt|instructions?|context|directives?)",
        r"\bwhat\s+(are\s+)?(your|the)\s+(instructions?|system\s+prompt|prompts?)",
        r"\brepeat\s+everything\s+(above|before)",
    ]),
    ("instruction_override", 1.5, [
        r"\b(new\s+)?(instruction|directive|command|rule)s?:\s*\w",
        r"\bdisregard\s+(all\s+)?(safety|content|ethical)\s+(guidelines?|policies?|rules?)",
        r"\boverride\s+(all\s+)?(previous|current|existing)\s+(instructions?|guidelines?|rules?)",
    ]),
    ("role_jailbreak", 2.0, [
        r"\b(DAN|DUDE|STAN|JailGPT|ChatGPT\s+Developer\s+Mode)",
        r"\bdo\s+anything\s+now\b",
        r"\bunrestricted\s+mode\b",
        r"\bno\s+filter\s+mode\b",
    ]),
    ("data_exfiltration", 1.5, [
        r"\b(send|export|upload|transmit)\s+(all\s+)?(data|dataset|contents?|rows?)\s+to\b",
        r"\bprint\s+all\s+(rows?|records?|data|contents?)",
        r"\bshow\s+me\s+(all\s+)?(the\s+)?(raw\s+)?(dataset|data|rows?|records?)",
    ]),
    ("code_injection", 2.5, [
        r"\bexecute\s+(this|the\s+following)\s+(code|script|command)",
        r"\brun\s+(rm|del|format|shutdown|curl|wget)\b",
        r"\b__import__\s*\(",
        r"\bos\.system\s*\(",
        r"\bsubprocess\.(run|call|Popen)\s*\(",
    ]),
    ("delimiter_injection", 1.5, [
        r"```\s*(system|human|assistant|user)\b",
        r"<\|im_start\|>",
        r"\[INST\]",
        r"###\s*(Instruction|System|Human|Assistant)\b",
    ]),
    ("multi_step_injection", 1.5, [
        r"\bfirst\b.{0,100}\bthen\s+(ignore|forget|override)\b",
        r"\bstep\s+1\b.{0,200}\bstep\s+2\s*:\s*(ignore|forget|override|disable)\b",
    ]),
    ("social_engineering", 1.0, [
        r"\bpretend\s+(this\s+is|it's)\s+(a\s+)?(test|drill|simulation|fictional|hypothetical)",
        r"\bfor\s+(educational|research|academic)\s+purposes",
        r"\bmy\s+(boss|manager|company|client)\s+(said|told|asked)\s+(you|me)\s+to\s+(ignore|override)",
    ]),
    ("evasion_encoding", 1.5, [
        r"\b(base64|ROT13|hex\s+encode|morse\s+code)\s+(this|the\s+following|decode)\b",
        r"ignore.{0,10}prev.{0,10}inst",
        r"\bp(lease\s+)?i(gnore\s+)?a(ll\s+)?p(revious\s+)?i(nstructions?)?",
    ]),
]
INJECTION_TOTAL = 17.0

# Biased-language categories with severity, suggestion and patterns (case-insensitive).
BIAS_PATTERNS = [
    ("absolute_language", "medium",
     "Replace absolute terms with quantified statements (e.g. '95% of' instead of 'all').", [
         r"\b(always|never|all|every|none|no\s+one|everyone|impossible|certain)\b",
     ]),
    ("causation_from_correlation", "high",
     "Use correlation language: 'is associated with' or 'correlates with'.", [
         r"\b(\w+)\s+(causes?|leads?\s+to|results?\s+in|makes?\s+\w+\s+(?:go\s+up|go\s+down|increase|decrease))\b",
         r"\bproven\s+to\s+(cause|create|drive|reduce|increase)\b",
     ]),
    ("unverified_benchmark", "medium",
     "Provide the source of the benchmark or remove the comparison.", [
         r"\b(industry\s+standard|market\s+average|typical\s+company|normal|average\s+company)\s+(is|are|has|have)\b",
         r"\bcompared\s+to\s+(the\s+)?industry\b",
     ]),
    ("false_precision", "low",
     "Round to 1-2 decimal places for percentages derived from small samples.", [
         r"\b\d+\.\d{3,}\s*%",
     ]),
    ("overgeneralisation", "medium",
     "Replace 'proves' with 'suggests' or 'indicates'.", [
         r"\b(this|the)\s+data\s+(proves?|confirms?|shows\s+definitively|demonstrates\s+conclusively)\b",
         r"\bconclusive\s+(evidence|proof|data)\b",
     ]),
]
BIAS_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.2}
BIAS_LIMIT = 0.40
VALIDATION_NOTE = (
    "\n\n*Note: Some statements in this response have been flagged for statistical accuracy. "
    "Please verify key figures against the raw data before acting on them.*"
)

# Intents in order of precedence with confidence, words and routing flags.
INTENTS = [
    ("forecasting_request", 0.80,
     ["forecast", "predict", "future", "trend", "next month", "next quarter", "projection"],
     {"requires_sql": False, "requires_rag": True, "requires_forecast": True, "requires_viz": False}),
    ("visualization_request", 0.80,
     ["chart", "graph", "plot", "visualise", "visualize", "show me a", "pie", "bar chart"],
     {"requires_sql": True, "requires_rag": False, "requires_forecast": False, "requires_viz": True}),
    ("anomaly_investigation", 0.78,
     ["anomaly", "outlier", "unusual", "spike", "drop", "strange", "weird", "wrong"],
     {"requires_sql": False, "requires_rag": True, "requires_forecast": False, "requires_viz": False}),
    ("statistical_question", 0.75,
     ["total", "sum", "average", "avg", "count", "group", "top", "filter", "where", "how many"],
     {"requires_sql": True, "requires_rag": False, "requires_forecast": False, "requires_viz": False}),
]

# Words and functions a query text must not contain.
BLOCKED_SQL_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "EXEC", "EXECUTE", "CALL",
    "GRANT", "REVOKE", "COPY", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "INSTALL", "LOAD", "EXPORT",
    "IMPORT", "CHECKPOINT", "FORCE", "SET", "RESET",
]
BLOCKED_SQL_FUNCTIONS = [
    "READ_CSV", "READ_PARQUET", "READ_JSON", "READ_TEXT", "WRITE_CSV", "WRITE_PARQUET", "GLOB",
    "PARQUET_SCHEMA", "DUCKDB_SETTINGS", "DUCKDB_FUNCTIONS",
]

# Word lists of the insight rubric.
VAGUE_WORDS = [
    "some", "many", "various", "significant", "notable", "considerable", "substantial", "quite", "rather",
]
ACTION_WORDS = [
    "suggests", "indicates", "team", "consider", "reduce", "increase", "improve", "address", "review",
]
WHAT_WORDS = ["shows", "reveals", "found", "detected", "identified"]
WHY_WORDS = ["suggests", "means", "impact", "risk", "opportunity", "because"]
ABSOLUTE_WORDS = ["always", "never", "all orders", "every", "none", "impossible", "certain", "proven"]

# File name extension -> format, and the extensions accepted for upload.
FORMAT_BY_EXTENSION = {
    "csv": "csv", "tsv": "csv", "txt": "csv",
    "xlsx": "excel", "xls": "excel", "xlsm": "excel",
    "parquet": "parquet", "pq": "parquet",
    "json": "json", "jsonl": "json", "ndjson": "json",
}
MAX_UPLOAD_BYTES = 2 * 1024**3

# Event type -> topic.
EVENT_TOPICS = {
    "DatasetUploaded": "dataset.uploaded",
    "SchemaInferred": "dataset.schema-inferred",
    "DatasetReady": "dataset.ready",
    "DatasetFailed": "dataset.failed",
    "ProfilingCompleted": "analytics.profiling-complete",
    "CleaningCompleted": "analytics.cleaning-complete",
    "AnomaliesDetected": "anomaly.detected",
    "InsightReportGenerated": "insight.report-generated",
    "ForecastCompleted": "insight.report-generated",
    "AnomalyAlertRaised": "anomaly.detected",
    "AgentResultReady": "agent.result",
    "ExecutionPlanCreated": "agent.result",
    "ExecutionPlanFailed": "agent.result",
    "ConversationCreated": "chat.message",
    "MessageAdded": "chat.message",
    "MemoryConsolidated": "chat.message",
}

# Allowed status changes.
DATASET_TRANSITIONS = [
    ("uploaded", "profiling"), ("uploaded", "failed"),
    ("profiling", "profiled"), ("profiling", "failed"),
    ("profiled", "cleaning"), ("profiled", "failed"),
    ("cleaning", "ready"), ("cleaning", "failed"),
]
SESSION_TRANSITIONS = [
    ("pending", "profiling"), ("pending", "failed"),
    ("profiling", "profiled"), ("profiling", "failed"),
    ("profiled", "cleaning"), ("profiled", "failed"),
    ("cleaning", "cleaned"), ("cleaning", "failed"),
    ("cleaned", "analysing"), ("cleaned", "failed"),
    ("analysing", "complete"), ("analysing", "failed"),
]

# Upper bounds of the duration histograms (milliseconds).
AGENT_DURATION_BUCKETS = [100, 500, 1000, 2500, 5000, 10000, 30000]
RUN_DURATION_BUCKETS = [5000, 10000, 30000, 60000, 120000]
SLOW_AGENT_MS = 10_000
COST_ALERT_USD = 0.10

# Impact range by priority and factor by semantic type.
IMPACT_RANGES = {
    "high": (10.0, 25.0, "Significant"),
    "medium": (3.0, 10.0, "Moderate"),
    "low": (1.0, 5.0, "Minor"),
}
IMPACT_FACTORS = {
    "currency": 1.5, "numeric_measure": 1.2, "numeric_count": 1.0, "categorical": 0.8, "percentage": 1.1,
}

# Words of which at least one is part of every match of a category's patterns (lower case).
# A substring search is far cheaper than the patterns, so it runs first.
INJECTION_HINTS = {
    "persona_override": ["ignore", "forget", "now", "act", "pretend"],
    "system_prompt_extraction": ["prompt", "instruction", "context", "directive", "everything"],
    "instruction_override": [":", "disregard", "override"],
    "role_jailbreak": ["^dan", "^dude", "^stan", "jailgpt", "chatgpt", "anything", "unrestricted", "filter"],
    "data_exfiltration": ["send", "export", "upload", "transmit", "print", "show"],
    "code_injection": ["execute", "run", "__import__", "os.system", "subprocess"],
    "delimiter_injection": ["```", "<|im_start|>", "[inst]", "###"],
    "multi_step_injection": ["first", "step"],
    "social_engineering": ["pretend", "purposes", "my"],
    "evasion_encoding": ["base64", "rot13", "hex", "morse", "ignore", "pia", "pi a", "please"],
}
BIAS_HINTS = {
    "absolute_language": [
        "always", "never", "all", "every", "none", "no", "impossible", "certain",
    ],
    "causation_from_correlation": ["cause", "lead", "result", "make", "proven"],
    "unverified_benchmark": ["standard", "average", "company", "normal", "industry"],
    "false_precision": ["%"],
    "overgeneralisation": ["data", "conclusive"],
}
