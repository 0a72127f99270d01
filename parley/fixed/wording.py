"""Reply, reason and label texts written by the jobs."""

from __future__ import annotations

# Thread layout.
BRAND = "AmazonHelp"
CUSTOMER = "Customer"
TURN_SEPARATOR = " | "
NO_CONTEXT = "None (opening turn)"
PAIR_PREFIX = "amz_"

# Redaction, applied in this order (pattern, case-insensitive?, placeholder).
PII_RULES = [
    (r"[\w\.-]+@[\w\.-]+\.\w+", True, "[EMAIL]"),
    (r"(\+?\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}", False, "[PHONE]"),
    (
        r"\b(order|tracking|ticket|id)[:\s#]+(?=[a-z0-9\-]*\d)[a-z0-9\-]{5,}\b|\b\d{3}-\d{7}-\d{7}\b",
        True,
        "[ORDER_ID]",
    ),
    (r"https?://\S+|www\.\S+", False, "[LINK]"),
]

# Words that mark a message as English for sampling.
ENGLISH_WORDS = (
    r"\b(my|the|is|to|order|delivery|package|refund|item|account|delayed|prime|return|charge|cancel"
    r"|received|card|tracking)\b"
)

# Intent scoring.
BASE_SCORE = 0.05
AMBIGUITY_MARGIN = 0.15
AMBIGUITY_TOP = 0.40
FALLBACK_CONFIDENCE = 0.35
OVERRIDE_CONFIDENCE = 0.96
OVERRIDE_MARGIN = 0.92
NO_MATCH = "No specific pattern matched."
OVERRIDE_TEXT = "Safety Guardrail Triggered: Matched high-risk pattern for "

# Precedent corpus.
RARE_INTENTS = [
    "billing_payment_disputes",
    "account_access_security",
    "order_cancellation_modification",
    "delivery_not_received",
    "product_inquiry_availability",
]
RARE_CAP = 250
COMMON_CAP = 200
STORE_TARGET = 2400

# Retrieval.
MAX_TERMS = 15000
SAME_CATEGORY_BOOST = 1.35
OTHER_CATEGORY_FACTOR = 0.65
MIN_SCORE = 0.05
TOP_K = 3

# Escalation policy.
CRISIS_WORDS = r"\b(lawyer|attorney|police|court|ftc|sue\s+(you|amazon)|fraudulent\s+charge|account\s+hacked)\b"
REASON_NO_INTENT = "Escalated: No intent prediction available."
REASON_CRISIS = "Escalated: Customer inquiry contains explicit legal, regulatory, or crime allegation."
REASON_UNCLEAR = (
    "Escalated: Query intent is unclassifiable or unclear ('other_unclear'); human triage required."
)
REASON_MANDATORY = (
    "Escalated: Intent '%s' is categorized as %s risk and requires mandatory human handling per policy."
)
REASON_CONFIDENCE = (
    "Escalated: Intent confidence (%s) is below operational threshold (%s) or prediction is ambiguous."
)
REASON_GROUNDING = (
    "Escalated: No relevant precedent retrieved with similarity >= %s (found %d qualified precedents)."
)
REASON_APPROVED = (
    "Autonomous handling approved: High confidence (%s%%) in intent '%s' backed by %d qualified grounding "
    "precedent(s)."
)

# Drafted replies.
GREETING = "Hello! "
NO_DOCS_REPLY = (
    "Thank you for contacting customer support. We are looking into your request. "
    "A support specialist will assist you shortly."
)
SPECIALIST_REPLY = (
    "I am connecting you with a customer support specialist who can review your account "
    "and assist with this directly. Your inquiry has been prioritized."
)
SIGN_OFF = r"\s*\^[A-Z]{2,3}\s*$"
LEADING_HANDLE = r"^@\w+\s+"
POLICY_TITLE = "Policy Specification"
HISTORY_TITLE = "Historical Customer Query"

# Fixed-answer and keyword baselines.
ALWAYS_REASON = "Trivial baseline fixed policy: Always escalate to human agent for safety."
NEVER_REASON = "Trivial baseline fixed policy: Never escalate; attempt 100% autonomous deflection."
ALWAYS_REPLY = "I am transferring your request to a support specialist who can assist you directly."
NEVER_REPLY = (
    "Thank you for contacting customer support. We have received your inquiry. "
    "You can check your order status, track shipments, and find answers to common questions "
    "anytime in our Help Center at amazon.com/help."
)
KEYWORD_HANDOFF_REPLY = (
    "Your request has been escalated to a customer support specialist for prioritized review. "
    "A representative will contact you shortly."
)
KEYWORD_REASON_INTENT = "Rule escalation: Intent '%s' is a high-risk policy category."
KEYWORD_REASON_WORDS = "Rule escalation: Query contains high-friction sentiment or escalation keywords."
KEYWORD_REASON_AUTO = "Rule: Query matched standard autonomous intent without risk triggers."

# Gold labels, (intent, reason) for intents that always escalate.
LABEL_MANDATORY = [
    (
        "billing_payment_disputes",
        "Mandatory human escalation: Involves unauthorized debits, payment disputes, or financial "
        "transactions requiring secure billing verification.",
    ),
    (
        "account_access_security",
        "Mandatory human escalation: Account compromised, locked out, or 2FA failure; requires identity "
        "verification by security team.",
    ),
    (
        "customer_service_escalation",
        "Mandatory human escalation: Severe customer dissatisfaction, previous agent failure, or "
        "legal/regulatory threat requiring supervisory review.",
    ),
    (
        "carrier_physical_delivery_issue",
        "Mandatory human escalation: Driver safety incident, conduct complaint, or property/pet damage "
        "requiring logistics operations review.",
    ),
]
LABEL_ANGRY = (
    "Mandatory human escalation: Severe frustration, abusive language, or profanity requiring empathetic "
    "human de-escalation."
)
LABEL_HIGH_RISK = (
    "Mandatory human escalation: High-risk scenario requiring human review and verification."
)
LABEL_MULTI_WORDS = ["attorney", "lawyer", "manager", "dispute", "refund", "cancel"]
LABEL_MULTI = "High friction / legal / multi-issue complexity requiring human agent de-escalation."
LABEL_MISSING_WORDS = ["cancel it", "refund the amount", "never got it", "dispute"]
LABEL_MISSING = (
    "Human escalation: Customer demands immediate refund/cancellation on package already marked delivered."
)
LABEL_CASHBACK_WORDS = ["cashback", "months"]
LABEL_CASHBACK = (
    "Human escalation: Prolonged cashback dispute exceeding normal policy resolution windows."
)
LABEL_AUTO = [
    (
        "order_status_delay",
        "Autonomous handling: In-transit tracking inquiry resolvable with real-time tracking link and "
        "estimated delivery date confirmation.",
    ),
    (
        "delivery_not_received",
        "Autonomous handling: Premature scan guidance advising 24-36h window and missing package search tips.",
    ),
    (
        "returns_refunds",
        "Autonomous handling: Standard 30-day return policy and Online Returns Center label generation "
        "instructions.",
    ),
    (
        "damaged_defective_wrong_item",
        "Autonomous handling: Damaged or defective product replacement initiated through standard Returns "
        "Center portal.",
    ),
    (
        "prime_subscription_benefits",
        "Autonomous handling: Prime Video, Music Unlimited, or membership benefit FAQ covered by knowledge base.",
    ),
    (
        "order_cancellation_modification",
        "Autonomous handling: Standard cancellation guidance via Your Orders before dispatch.",
    ),
    (
        "product_inquiry_availability",
        "Autonomous handling: Product compatibility or restock alert guidance covered by knowledge base.",
    ),
    (
        "other_unclear",
        "Autonomous handling: Polite clarification request or redirect to Amazon Seller Central.",
    ),
]
LABEL_DEFAULT = "Autonomous handling: Request meets standard policy criteria for automated guidance."

# Tiers, review states and validation quotas in output order.
TIERS = ["routine", "ambiguous", "high_risk", "multi_issue", "low_signal", "angry_profane"]
REVIEW_PENDING = "auto_labeled_pending_review"
REVIEW_STATES = ["auto_labeled_pending_review", "human_verified", "manually_verified"]
VALIDATION_QUOTAS = [
    ("routine", 12),
    ("ambiguous", 8),
    ("high_risk", 6),
    ("multi_issue", 4),
    ("low_signal", 2),
    ("angry_profane", 3),
]
GOLD_TARGET = 200

# Rubric judge.
URL_PATTERN = r"https?://\S+"
TIME_SPAN_PATTERN = r"\b(\d+\s+(days?|hours?|weeks?|months?))\b"
COURTESY_PATTERN = r"\b(hello|hi|sorry|apologies|thank|help|assist)\b"
CRITIQUE_ESCALATED = "Interaction appropriately prioritized and escalated to human specialist per policy."
CRITIQUE_URL = "URL '%s' not found in retrieved precedents."
CRITIQUE_TIME = "Timeframe '%s' not explicitly stated in retrieved precedent."
CRITIQUE_RETURN = "Inquiry about return not directly addressed in reply."
CRITIQUE_TRACK = "Tracking inquiry lacked tracking path."
CRITIQUE_CLEAN = "Grounded cleanly in precedent with empathetic tone and clear guidance."
CRITIQUE_MODEL = "Scored via LLM-as-a-judge."
NOTE_HANDOFF = "Appropriate handoff to specialist."
NOTE_AMBIGUOUS = "Minor ambiguity in customer query nuance."
NOTE_MULTI = "Addressed primary issue, secondary issue left to customer follow-up."
NOTE_CLEAN = "Cleanly grounded in precedent with polite support tone."

# Agreement labels by lower bound of kappa.
KAPPA_LABELS = [
    (0.81, "Almost Perfect Agreement"),
    (0.61, "Substantial Agreement"),
    (0.41, "Moderate Agreement"),
    (0.21, "Fair Agreement"),
]
KAPPA_LOWEST = "Slight / Poor Agreement"

# Scorecard entries used while a baseline run is absent (metric, always, keyword).
SCORECARD_DEFAULTS = [
    ("intent_accuracy", 0.135, 0.605),
    ("escalation_accuracy", 0.365, 0.775),
    ("false_auto_handle_rate", 0.0, 0.5068),
    ("false_escalation_rate", 1.0, 0.063),
]
SAFETY_PASS = "PASS: 0 Critical False Auto-Handles"
SAFETY_FAIL = "FAIL: %d Critical False Auto-Handles detected"
