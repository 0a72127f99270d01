"""Intent pattern pack and safety overrides (case-insensitive, searched anywhere in the text)."""

from __future__ import annotations

# Fixed values: (intent, pattern, weight) in pack order.
INTENT_PATTERNS = [
    ("delivery_not_received", r"\b(marked|says|said|showing)\s+delivered\b", 0.90),
    ("delivery_not_received", r"(?<!supposed to be )\bdelivered\b.*\b(not|never|didn't|haven't)\s+(receive|get|arrive|here)\b", 0.95),
    ("delivery_not_received", r"\bporch\b.*\b(stolen|missing|not here|nothing)\b", 0.85),
    ("delivery_not_received", r"\bhaven't received\b.*\b(package|order|it)\b", 0.80),
    ("order_status_delay", r"\b(where\s+is\s+my|track|tracking\s+status|tracking\s+number)\b", 0.85),
    ("order_status_delay", r"\b(preparing\s+for\s+shipment|preparing\s+to\s+ship|not\s+yet\s+shipped|hasn't\s+shipped|yet\s+to\s+ship)\b", 0.95),
    ("order_status_delay", r"\bwhen\s+(will\s+it|it'll)\s+(actually\s+)?ship\b", 0.92),
    ("order_status_delay", r"\b(when\s+will|when\s+is)\b.*\b(ship|dispatched?)\b", 0.88),
    ("order_status_delay", r"\border(ed)?\b.*\b(days?|weeks?)\s+ago\b.*\b(ship|status|preparing)\b", 0.90),
    ("order_status_delay", r"\b(order\s+status|status\s+of\s+(my\s+)?order)\b", 0.90),
    ("order_status_delay", r"\b(was\s+supposed\s+to\s+be\s+delivered|supposed\s+to\s+arrive)\b", 0.90),
    ("order_status_delay", r"\b(hasn't\s+arrived|not\s+arrived|not\s+delivered|delayed|running\s+late)\b", 0.80),
    ("order_status_delay", r"\bwhen\s+will\s+(my|the|this)\b.*\barrive\b", 0.85),
    ("order_status_delay", r"\bestimated\s+delivery\b", 0.75),
    ("order_status_delay", r"\bone\s+day\s+shipping\b.*\b(late|three\s+days|days)\b", 0.80),
    ("returns_refunds", r"\b(return|refund|money\s+back|cashback|reimburse|exchange)\b", 0.80),
    ("returns_refunds", r"\bhow\s+do\s+i\s+return\b", 0.90),
    ("returns_refunds", r"\breturn\s+(label|item|dress|shoes|package)\b", 0.85),
    ("returns_refunds", r"\bmoney\s+is\s+not\s+refunded\b", 0.90),
    ("returns_refunds", r"\bwant\s+my\s+refund\b", 0.85),
    ("damaged_defective_wrong_item", r"\b(damaged|broken|crushed|shattered|cracked|torn|defect|defective)\b", 0.85),
    ("damaged_defective_wrong_item", r"\b(wrong\s+item|wrong\s+size|wrong\s+color|different\s+item|not\s+working)\b", 0.90),
    ("damaged_defective_wrong_item", r"\b(poor\s+quality|faulty|zipper\s+broke|battery\s+capacity)\b", 0.80),
    ("billing_payment_disputes", r"\b(charged\s+(\w+\s+)?twice|double\s+charge|charged\s+(\w+\s+)?\d+\s+times|overcharged)\b", 0.95),
    ("billing_payment_disputes", r"\b(unauthorized\s+charge|fraudulent\s+charge|dispute\s+the\s+charge|dispute)\b", 0.95),
    ("billing_payment_disputes", r"\bautomatically\s+taking\s+money\b.*\bbank\b", 0.90),
    ("billing_payment_disputes", r"\bcredit\s+card\b.*\bcharge\b", 0.85),
    ("billing_payment_disputes", r"\bpayment\s+declined|payment\s+failed\b", 0.80),
    ("account_access_security", r"\b(locked\s+out|account\s+locked|locked\s+my\s+account)\b", 0.95),
    ("account_access_security", r"\b(hacked|compromised|unauthorized\s+login)\b", 0.95),
    ("account_access_security", r"\b(password\s+reset|otp|2fa|two-step|tfa\s+code)\b", 0.85),
    ("account_access_security", r"\bcan't\s+log\s+in|cannot\s+sign\s+in\b", 0.90),
    ("carrier_physical_delivery_issue", r"\b(delivery\s+guy|delivery\s+driver|courier|delivery\s+boy|driver)\b", 0.80),
    ("carrier_physical_delivery_issue", r"\b(threw|gate\s+open|dog\s+out|puppy|police|hit\s+my\s+car)\b", 0.90),
    ("carrier_physical_delivery_issue", r"\bring\s+door\s*bell\b", 0.75),
    ("carrier_physical_delivery_issue", r"\bleft\s+it\s+in\s+the\s+(driveway|rain)\b", 0.85),
    ("order_cancellation_modification", r"\b(cancel\s+my\s+order|cancel\s+this\s+order|cancel\s+order|cancel\s+it)\b", 0.90),
    ("order_cancellation_modification", r"\bchange\s+(my\s+)?(delivery\s+)?address\b", 0.90),
    ("order_cancellation_modification", r"\bnot\s+able\s+to\s+cancel\b", 0.85),
    ("customer_service_escalation", r"\b(worst\s+customer\s+service|pathetic\s+service|terrible\s+service|useless)\b", 0.85),
    ("customer_service_escalation", r"\b(speak\s+to\s+supervisor|talk\s+to\s+a\s+manager|escalat|demand\s+attention)\b", 0.90),
    ("customer_service_escalation", r"\b(attorney|lawyer|better\s+business\s+bureau|ftc|court)\b", 0.95),
    ("customer_service_escalation", r"\byour\s+customer\s+service\s+sucks\b", 0.90),
    ("prime_subscription_benefits", r"\b(prime\s+video|prime\s+membership|prime\s+subscription|music\s+unlimited)\b", 0.85),
    ("prime_subscription_benefits", r"\b(annual\s+subscription|prime\s+member|join\s+prime|cancel\s+prime)\b", 0.80),
    ("prime_subscription_benefits", r"\b(stream\s+movies|watch\s+movies|cloud\s+storage)\b", 0.75),
    ("product_inquiry_availability", r"\b(when\s+do\s+y'all\s+restock|restock|in\s+stock|out\s+of\s+stock)\b", 0.85),
    ("product_inquiry_availability", r"\b(compatible\s+with|work\s+in\s+ireland|alexa\s+work)\b", 0.85),
    ("product_inquiry_availability", r"\bwhen\s+will\b.*\bbe\s+available\b", 0.80),
]

# Overrides tried in this order before the pack.
SAFETY_OVERRIDES = [
    ("billing_payment_disputes", r"\b(unauthorized\s+charge|fraud|dispute\s+the\s+charge|charged\s+twice)\b"),
    ("account_access_security", r"\b(locked\s+out|can't\s+log\s+in|stolen\s+password|hacked)\b"),
    ("customer_service_escalation", r"\b(attorney|lawyer|police|ftc|better\s+business\s+bureau)\b"),
]
