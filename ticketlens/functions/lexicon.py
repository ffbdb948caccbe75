"""Word lists, patterns, costs, thresholds and message texts.

Everything in this module is data that results depend on.  It is kept apart
from the logic so that the Spark expressions, the registered SQL functions and
the reference SQL of the catalog all read the same strings.
"""

from __future__ import annotations

# --- fixed values: domains and labels -------------------------------------
DOMAINS = ["technical", "billing", "returns", "escalation"]
LABELS = ["resolved", "escalate"]
DEFAULT_LABEL = "resolved"
ROLES = ["user", "assistant", "system"]

DOMAIN_DESCRIPTIONS = {
    "technical": "technical support and device troubleshooting",
    "billing": "billing, payments, and subscription",
    "returns": "returns, exchanges, and shipping",
    "escalation": "urgent or sensitive customer escalation",
}
PROMPT = (
    "### System:\nYou are a helpful customer support agent for {domain} issues. "
    "Respond clearly, empathetically, and with concrete action.\n\n"
    "### Customer:\n{ticket}\n\n### Agent:\n{response}"
)

# --- fixed values: escalation lexicons (router and guard differ) ------------
ROUTER_ANGER = ["furious", "unacceptable", "outraged", "disgusted", "ridiculous", "useless",
                "incompetent"]
ROUTER_THREAT = ["chargeback", "lawsuit", "legal action", "sue", "report", "BBB", "FTC",
                 "trading standards", "fraud"]
ROUTER_URGENCY = ["immediately", "right now", "NOW", "ASAP", "last chance", "final warning"]
GUARD_ANGER = ["furious", "unacceptable", "outraged", "disgusted", "useless", "incompetent"]
GUARD_THREAT = ["chargeback", "lawsuit", "legal action", "sue", "BBB", "FTC", "fraud"]
GUARD_URGENCY = ["immediately", "right now", "NOW"]
ANGER_WEIGHT, THREAT_WEIGHT, URGENCY_WEIGHT = 0.35, 0.50, 0.20
ESCALATION_THRESHOLD = 0.60
FALLBACK_ESCALATION = 0.50
FALLBACK_DOMAIN_SCORE = 0.75

# --- fixed values: keyword domain detector ----------------------------------
DOMAIN_KEYWORDS = {
    "technical": ["firmware", "bluetooth", "wifi", "crash", "bug", "update", "driver", "sync",
                  "reboot"],
    "billing": ["charge", "refund", "invoice", "subscription", "billing", "payment", "cancel",
                "receipt"],
    "returns": ["return", "exchange", "damaged", "wrong item", "ship", "replacement", "warranty",
                "label"],
}
DOMAIN_KEYWORD_MIN_HITS = 2

# --- fixed values: rule-based response score ---------------------------------
RESPONSE_WEIGHTS = {"empathy": 0.20, "action": 0.25, "clarity": 0.20, "length": 0.15,
                    "policy": 0.20}
SCORE_EMPATHY = ["i'm sorry", "i apologise", "i understand", "that must be", "thank you for",
                 "i can see", "i appreciate"]
SCORE_ACTION = ["i will", "i've", "i have", "we will", "we've", "processing", "arranging",
                "escalating", "refunding", "replacing"]
SCORE_VAGUE = ["please contact", "please visit", "unfortunately we cannot", "as per policy",
               "i cannot help with that"]
POLICY_KEYWORDS = {
    "technical": ["step", "try", "restart", "reset", "update", "check"],
    "billing": ["refund", "charge", "invoice", "account", "payment"],
    "returns": ["return", "label", "ship", "exchange", "replacement"],
    "escalation": ["escalat", "specialist", "manager", "priority", "case id"],
}

# --- fixed values: tone score -------------------------------------------------
TONE_EMPATHY = ["sorry", "apologise", "apologies", "understand", "frustrat", "thank you",
                "appreciate", "help you", "i can see"]
TONE_ACTION = ["i will", "i've", "processing", "arranging", "refunding", "replacing",
               "escalating", "looking into"]

# --- fixed values: compliance rules (domain -> rule -> (any-of words, none-of words)) ---
COMPLIANCE_RULES = {
    "billing": {
        "mentions_account": (["account", "charge", "payment", "refund"], []),
        "no_pii_exposure": ([], ["password", "ssn"]),
        "action_stated": (["i will", "i've", "processed", "refund"], []),
    },
    "escalation": {
        "contains_apology": (["sorry", "apologise", "apologies"], []),
        "provides_case_id": (["case", "ticket", "reference", "id"], []),
        "escalates": (["specialist", "manager", "escalat", "priority"], []),
    },
    "technical": {
        "actionable_steps": (["step", "try", "restart", "reset", "check"], []),
    },
    "returns": {
        "return_guidance": (["return", "label", "ship", "exchange"], []),
    },
}

# --- fixed values: personal-data patterns, applied in this order -----------------
PII_PATTERNS = [
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[SSN REDACTED]"),
    ("visa", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[CARD REDACTED]"),
    ("mastercard", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[CARD REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL REDACTED]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    ("password", r"(?i)\bpassword\s*[:=]\s*\S+", "[PASSWORD REDACTED]"),
]

# --- fixed values: tone check -------------------------------------------------
RUDE_WORDS = ["stupid", "idiot", "dumb", "shut up", "don't bother", "not my problem"]
DEFLECTION_WORDS = ["cannot help", "unable to assist", "please contact", "refer to our website"]
MIN_RESPONSE_WORDS, MIN_ESCALATION_WORDS, DEFLECTION_MAX_WORDS = 20, 15, 30

ESCALATION_REPLY = (
    "I sincerely apologise for the frustration this has caused. "
    "I'm escalating your case to a senior specialist who will contact you "
    "within the hour. Your case reference is {case}. We take your concerns very seriously."
)

# --- fixed values: unsupported-claim heuristics -------------------------------
INVENTED_PATTERNS = [
    r"(?i)\border #\d{6,}\b",
    r"\$\d+\.\d{2}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?i)\btracking number\s+\w{8,}\b",
]
# lower-case text that every match of the pattern at the same place contains
INVENTED_HINTS = ["order #", "$", "-", "tracking number"]
CONTRADICTION_HINTS = ["no charge", "no issue", "delivered"]
CONTRADICTIONS = [
    (r"(?i)\bno charge\b", r"(?i)\bcharg\w+\b"),
    (r"(?i)\bno issue\b", r"(?i)\bproblem\b"),
    (r"(?i)\bdelivered\b", r"(?i)\bnot received\b"),
]
UNSUPPORTED_PHRASES = [
    "as per our conversation last week",
    "as discussed previously",
    "according to your records",
    "your last order of",
    "the technician visited on",
    "we spoke on",
]
INVENTED_WEIGHT, CONTRADICTION_WEIGHT, PHRASE_WEIGHT, SHORT_WEIGHT = 0.30, 0.40, 0.25, 0.10
UNSUPPORTED_EVAL_THRESHOLD, UNSUPPORTED_SERVING_THRESHOLD = 0.60, 0.50

# --- fixed values: routing, selection, cost -------------------------------------
CONFIDENCE_THRESHOLDS = {"technical": 0.70, "billing": 0.70, "returns": 0.70, "escalation": 0.50}
LOW_CONFIDENCE = 0.40
COMPOSITION_GAP = 0.15
HUMAN_ESCALATION_SCORE = 0.70
DEFAULT_ADAPTERS = {d: f"outputs/checkpoints/{d}_best" for d in DOMAINS}
DEFAULT_RANKS = {"technical": 32, "billing": 24, "returns": 28, "escalation": 8}
COST_PER_TICKET = {"technical": 0.05, "billing": 0.12, "returns": 0.09, "escalation": 0.15}
UNKNOWN_DOMAIN_COST = 0.10
BASELINE_COST = 0.50
LATENCY_SLA_MS = 200.0
FNR_BUDGET = 0.005
UNSUPPORTED_RATE_GATE = 0.05

# --- fixed values: quality gates, drift ------------------------------------------
MIN_CHARS, MAX_CHARS, IQR_MULTIPLIER = 10, 2000, 1.5
NEAR_DUPLICATE_JACCARD = 0.95
CENTROID_COSINE = 0.80
MAX_NOISE_RATE, MIN_ROWS_PER_DOMAIN = 0.10, 500
REQUEST_MIN_CHARS, REQUEST_MAX_CHARS = 5, 4000
DRIFT_COSINE = 0.94
EPOCH_DRIFT, EPOCH_SEVERE = 0.10, 0.20
DISTRIBUTION_SHIFT = 0.15
TRAINING_MIX = {"technical": 0.42, "billing": 0.28, "returns": 0.22, "escalation": 0.08}
PREFERENCE_GAP = 0.15

# --- fixed values: monitoring ----------------------------------------------------
LATENCY_BUCKETS_S = [0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0, 2.0]
ROUTING_CONFIDENT = 0.70
# (name, level, metric, comparison, threshold, cooldown seconds, message format, scale)
ALERT_RULES = [
    ("auto_resolution_warn", "warn", "auto_resolution_rate", "<", 0.90, 300,
     "Auto-resolution rate dropped to %.1f%% (target >94%%)", 100.0),
    ("auto_resolution_critical", "critical", "auto_resolution_rate", "<", 0.85, 60,
     "CRITICAL: Auto-resolution rate %.1f%% — investigate immediately", 100.0),
    ("escalation_fnr_critical", "critical", "false_negative_rate", ">", 0.005, 60,
     "SAFETY CRITICAL: Escalation FNR %.3f%% > 0.5%% budget — missed escalations in production",
     100.0),
    ("latency_sla_warn", "warn", "p95_ms", ">", 200.0, 300,
     "Latency p95 = %.0fms (SLA target <200ms)", 1.0),
    ("latency_sla_critical", "critical", "p95_ms", ">", 350.0, 60,
     "CRITICAL: Latency p95 = %.0fms", 1.0),
    ("semantic_drift_warn", "warn", "drift_detected", ">", 0.5, 300,
     "Semantic drift detected: domains=", 1.0),
    ("hallucination_warn", "warn", "unsupported_rate", ">", 0.03, 300,
     "Hallucination rate = %.1f%% (warn >3%%)", 100.0),
    ("hallucination_critical", "critical", "unsupported_rate", ">", 0.10, 60,
     "CRITICAL: Hallucination rate = %.1f%%", 100.0),
    ("cache_hit_rate_low", "warn", "cache_hit_rate", "<", 0.80, 600,
     "Cache hit rate = %.1f%% (warn <80%%) — consider increasing cache_size", 100.0),
    ("distribution_shift", "warn", "kl_divergence", ">", 0.15, 1800,
     "Domain distribution shift: kl=%.4f — consider re-calibrating router", 1.0),
]

# --- fixed values: ticket templates and slot values --------------------------------
TEMPLATES = {
    "technical": [
        "My {product} won't {action} after the {version} update.",
        "The {product} {component} keeps {failure_mode} randomly.",
        "I've tried {fix_attempt} but the {product} still {failure_mode}.",
        "{product} shows a '{error_code}' error whenever I try to {action}.",
        "Since the firmware update, my {product}'s {component} has been {failure_mode}.",
        "I can't get my {product} to {action} on {os_version}.",
        "The {product} app crashes every time I open the {feature} screen.",
        "My {product} disconnects from {connection} every {duration}.",
        "After factory reset, {product} still won't {action}.",
        "Is there a fix for the {product} {component} {failure_mode} issue?",
    ],
    "billing": [
        "I was charged {amount} on {date} but I didn't authorise this.",
        "I want to cancel my {plan} subscription and get a refund.",
        "My invoice for {date} shows {amount} but it should be {lower_amount}.",
        "I need to upgrade from {plan_from} to {plan_to} plan.",
        "My {payment_method} was declined but the charge still went through.",
        "Can I get a receipt for my {date} payment of {amount}?",
        "I was billed twice for the same order #{order_id}.",
        "My promo code {code} didn't apply at checkout.",
        "I'd like to pause my subscription for {duration}.",
        "When does my free trial end and how much will I be charged?",
    ],
    "returns": [
        "I received the wrong {product} in my order #{order_id}.",
        "My {product} arrived damaged — there is {damage_description}.",
        "I need to exchange my {product} for a {alternative} size.",
        "How do I return a {product} I bought {duration} ago?",
        "I lost my return label for order #{order_id}.",
        "My order #{order_id} says delivered but I never received it.",
        "The {product} stopped working after {duration}. I want a replacement.",
        "Can I return a gift without a receipt?",
        "How long does it take to process a return for order #{order_id}?",
        "I returned the {product} {duration} ago but haven't got my refund.",
    ],
    "escalation": [
        "This is absolutely unacceptable. I've been waiting {duration} and nobody has helped.",
        "I'm going to file a chargeback if this isn't resolved in {duration}.",
        "I've contacted support {n_contacts} times about order #{order_id}. Fix this NOW.",
        "I'm posting a 1-star review everywhere unless you refund my {amount} immediately.",
        "Your service is a disgrace. I want to speak to a manager RIGHT NOW.",
        "I'm a lawyer and I will be taking legal action if this isn't resolved by {date}.",
        "This is fraud. I'm reporting you to {authority} and my bank.",
        "I've been a loyal customer for {duration} and this is how you treat me?",
        "One more ignored message and I'm cancelling everything and disputing every charge.",
        "Completely useless. I've spent {duration} on the phone and nothing is resolved.",
    ],
}
SLOT_VALUES = {
    "product": ["wireless headphones", "Bluetooth speaker", "smart watch", "laptop", "tablet",
                "earbuds", "webcam", "keyboard", "mouse", "router"],
    "component": ["battery", "screen", "charging port", "microphone", "speaker",
                  "touch controls", "camera", "USB port", "power button"],
    "action": ["connect to Bluetooth", "charge", "turn on", "sync", "update",
               "pair with my phone", "play audio", "power off", "recognise my computer"],
    "failure_mode": ["disconnecting", "freezing", "crashing", "draining quickly",
                     "not responding", "overheating", "making noise", "restarting randomly"],
    "version": ["v2.4", "v3.1", "v1.8.2", "v4.0", "the latest", "v2.9.1"],
    "fix_attempt": ["restarting it", "a factory reset", "reinstalling the app",
                    "updating the firmware", "clearing the cache"],
    "error_code": ["ERR_0042", "SYNC_FAIL", "AUTH_ERROR", "CONN_TIMEOUT", "DEVICE_NOT_FOUND",
                   "UPDATE_FAILED", "0x80070002"],
    "os_version": ["iOS 17", "Android 14", "Windows 11", "macOS Ventura", "Ubuntu 22.04"],
    "connection": ["Bluetooth", "Wi-Fi", "USB", "my phone", "my laptop"],
    "feature": ["settings", "playlist", "equaliser", "notifications", "account"],
    "amount": ["$29.99", "$49.99", "$9.99", "$14.99", "$99.99", "$199.99"],
    "lower_amount": ["$24.99", "$39.99", "$7.99", "$12.99"],
    "date": ["last Tuesday", "3 days ago", "on the 15th", "yesterday", "last month"],
    "plan": ["Basic", "Pro", "Enterprise", "Student", "Family"],
    "plan_from": ["Basic", "Starter", "Free"],
    "plan_to": ["Pro", "Enterprise", "Business"],
    "payment_method": ["Visa ending in 4242", "Mastercard", "PayPal", "Apple Pay"],
    "order_id": ["#384921", "#773401", "#920183", "#651023", "#489302"],
    "code": ["SAVE20", "WELCOME10", "PROMO50", "SUMMER25"],
    "alternative": ["small", "medium", "large", "XL", "different colour"],
    "damage_description": ["a cracked screen", "a dented corner", "missing components",
                           "a broken hinge", "scratches on the surface"],
    "n_contacts": ["3", "4", "5", "6", "seven"],
    "authority": ["the BBB", "consumer protection", "the FTC", "trading standards"],
    "duration": ["two weeks", "three days", "a month", "48 hours", "over a week", "ten days",
                 "more than two weeks"],
}
