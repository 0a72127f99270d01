"""Word lists and broad scan patterns used by corpus profiling."""

from __future__ import annotations

# Words left out of content n-grams.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn "
    "doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn amazon help "
    "hi hello please thanks thank"
).split()

# Broad category patterns for example mining.
SCAN_PATTERNS = [
    ("ORDER_TRACKING_DELAY", r"\b(where is my|tracking|track|delay|delayed|late|hasn't arrived|not arrived|when will.*arrive|eta)\b"),
    ("DELIVERED_NOT_RECEIVED", r"\b(says delivered|marked delivered|said delivered|showing delivered|delivered.*(not|never|didn|haven)|haven't received.*delivered)\b"),
    ("RETURNS_REFUNDS", r"\b(refund|return|return label|money back|cashback|reimburse|exchange|send.*back)\b"),
    ("DAMAGED_DEFECTIVE_WRONG", r"\b(damaged|broken|crushed|shattered|wrong item|defective|not working|different item|wrong size|faulty)\b"),
    ("BILLING_PAYMENT_DISPUTES", r"\b(charged twice|double charge|unauthorized charge|overcharged|payment failed|deducted.*twice|bank|dispute)\b"),
    ("PRIME_SUBSCRIPTION_BENEFITS", r"\b(prime video|prime membership|annual subscription|prime member|music unlimited|prime delivery|cancel prime)\b"),
    ("ACCOUNT_ACCESS_SECURITY", r"\b(locked out|lock.*account|password|hacked|can't log in|login|otp|2fa|verification code)\b"),
    ("PHYSICAL_DELIVERY_CARRIER_INCIDENT", r"\b(delivery guy|driver|usps|courier|carrier|delivery boy|threw|doorstep|porch|stole)\b"),
    ("CANCELLATION_MODIFICATION", r"\b(cancel my order|cancel order|cancel it|change address|change shipping address|cancel this)\b"),
    ("CUSTOMER_SERVICE_ESCALATION", r"\b(worst customer service|pathetic service|speak to supervisor|talk to manager|terrible service|complaint|unhelpful|call me)\b"),
    ("PRODUCT_INQUIRY_AVAILABILITY", r"\b(in stock|out of stock|compatible with|restock|available in|when will.*be available|dimensions)\b"),
]
