"""Strata of the gold set: which pattern fills which tier, and how many rows it may take."""

from __future__ import annotations

# Fixed values: (intent, pattern, difficulty tier, quota) in fill order.
GOLD_STRATA = [
    ("order_status_delay", r"\bwhere\s+is\s+my\b", "routine", 8),
    ("order_status_delay", r"\b(tracking\s+number|track\s+my\s+order)\b", "routine", 6),
    ("order_status_delay", r"\bwas\s+supposed\s+to\s+arrive\b", "ambiguous", 5),
    ("order_status_delay", r"\b(one\s+day\s+shipping|next\s+day).*delayed\b", "multi_issue", 5),
    ("delivery_not_received", r"\b(marked|says|said)\s+delivered\b.*\b(not\s+here|haven't|never|nothing)\b", "routine", 8),
    ("delivery_not_received", r"\bporch\b.*\b(stolen|missing|not\s+here)\b", "ambiguous", 5),
    ("delivery_not_received", r"\bdelivered\b.*\b(cancel|refund)\b", "multi_issue", 4),
    ("delivery_not_received", r"\bfucking\s+not.*delivered\b", "angry_profane", 3),
    ("returns_refunds", r"\bhow\s+do\s+i\s+return\b", "routine", 8),
    ("returns_refunds", r"\breturn\s+label\b", "routine", 6),
    ("returns_refunds", r"\bmoney\s+is\s+not\s+refunded\b.*\b(month|weeks)\b", "ambiguous", 3),
    ("returns_refunds", r"\bcashback\b.*\bmonths\b", "multi_issue", 3),
    ("damaged_defective_wrong_item", r"\b(arrived\s+damaged|broken|shattered|cracked)\b", "routine", 8),
    ("damaged_defective_wrong_item", r"\b(wrong\s+size|wrong\s+item|different\s+item)\b", "routine", 6),
    ("damaged_defective_wrong_item", r"\bzipper\s+broke|defective\b.*\b(exchange|replace)\b", "ambiguous", 4),
    ("damaged_defective_wrong_item", r"\bfooled\s+me|poor\s+experience\b.*\bbattery\b", "multi_issue", 2),
    ("billing_payment_disputes", r"\b(unauthorized\s+charge|fraud|dispute\s+the\s+whole\s+charge)\b", "high_risk", 6),
    ("billing_payment_disputes", r"\bcharged\s+(\w+\s+)?twice\b", "high_risk", 6),
    ("billing_payment_disputes", r"\bcharged\s+3\s+times\b", "multi_issue", 4),
    ("billing_payment_disputes", r"\bautomatically\s+taking\s+money\b.*\bbank\b", "ambiguous", 4),
    ("billing_payment_disputes", r"\bpayment\s+declined|payment\s+failed\b", "routine", 2),
    ("prime_subscription_benefits", r"\bdo\s+u\s+i\s+need\s+to\s+pay\s+extra\b.*\bmovies\b", "routine", 4),
    ("prime_subscription_benefits", r"\bprime\s+video\b.*\bavailable\b", "routine", 4),
    ("prime_subscription_benefits", r"\bmusic\s+unlimited\b.*\bdevices\b", "routine", 4),
    ("prime_subscription_benefits", r"\bwhy\s+does\s+prime\s+member\b.*\bnot\s+give\b", "ambiguous", 4),
    ("account_access_security", r"\blocked\s+my\s+account|can't\s+get\s+into\b", "high_risk", 6),
    ("account_access_security", r"\b(password\s+assistance|otp|2fa|tfa)\b", "high_risk", 6),
    ("account_access_security", r"\bhacked\b", "high_risk", 4),
    ("account_access_security", r"\brecovery\s+phone\b", "ambiguous", 2),
    ("carrier_physical_delivery_issue", r"\b(puppy|police|hit\s+my\s+car|gate\s+open)\b", "high_risk", 4),
    ("carrier_physical_delivery_issue", r"\bthrew\s+(the\s+)?(parcel|box|package)\b", "angry_profane", 4),
    ("carrier_physical_delivery_issue", r"\bring\s+door\s*bell\b", "routine", 4),
    ("carrier_physical_delivery_issue", r"\bdelivery\s+guy\b.*\b(rude|complaint)\b", "ambiguous", 4),
    ("order_cancellation_modification", r"\bcancel\s+my\s+order\s+immediately\b", "routine", 5),
    ("order_cancellation_modification", r"\bhow\s+(do\s+)?i\s+cancel\s+my\s+order\b", "routine", 4),
    ("order_cancellation_modification", r"\bchange\s+(my\s+)?(delivery\s+)?address\b", "ambiguous", 3),
    ("order_cancellation_modification", r"\bnot\s+able\s+to\s+cancel\b", "multi_issue", 2),
    ("customer_service_escalation", r"\b(attorney|lawyer|ftc|better\s+business\s+bureau)\b", "high_risk", 4),
    ("customer_service_escalation", r"\b(worst\s+customer\s+service|pathetic\s+service|service\s+sucks)\b", "angry_profane", 5),
    ("customer_service_escalation", r"\b(talk\s+to\s+somebody|speak\s+to\s+a\s+manager|supervisor)\b", "ambiguous", 4),
    ("customer_service_escalation", r"\bwhat\s+a\s+joke.*team\s+i've\s+come\s+across\b", "angry_profane", 3),
    ("product_inquiry_availability", r"\bwhen\s+do\s+y'all\s+restock\b", "routine", 4),
    ("product_inquiry_availability", r"\bcompatible\s+with\b", "routine", 4),
    ("product_inquiry_availability", r"\bwhen\s+will\b.*\bbe\s+available\b", "ambiguous", 4),
    ("other_unclear", r"^(link\?+|\?+|help\?+|dm)$", "low_signal", 4),
    ("other_unclear", r"\bamazon\s+seller\s+account\b", "low_signal", 4),
    ("other_unclear", r"\b(dauerschleife|sonntag|relaxing|cup\s+of\s+tea)\b", "low_signal", 4),
]

# Curated gold rows; the literal row is used when no corpus row matches the pattern.
CURATED_ROWS = [
    {
        "pattern": r"Where is my package\? The tracking number is TRK-88219",
        "message_text": 'Where is my package? The tracking number is TRK-88219, it was supposed to arrive yesterday.',
        "true_intent": 'order_status_delay',
        "true_escalate": False,
        "escalate_reason": 'Standard delayed tracking request; autonomously resolvable via tracking status link.',
        "difficulty": 'routine',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'You can track your parcel in real-time here: https://amazon.com/your-orders. Let us know if you '
            'need further help! ^AM'
        ),
    },
    {
        "pattern": r"How do I return a dress that doesn't fit",
        "message_text": "How do I return a dress that doesn't fit? Where can I print the return label?",
        "true_intent": 'returns_refunds',
        "true_escalate": False,
        "escalate_reason": 'Standard return procedure question; resolvable autonomously with Online Returns Center guidance.',
        "difficulty": 'routine',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'You can initiate a return and print your prepaid label via our Online Returns Center: '
            'https://amazon.com/returns. ^CS'
        ),
    },
    {
        "pattern": r"Anyone know does Amazon Alexa work in Ireland",
        "message_text": (
            "Anyone know does Amazon Alexa work in Ireland? I can't download the app, says not available in "
            'your country.'
        ),
        "true_intent": 'product_inquiry_availability',
        "true_escalate": False,
        "escalate_reason": (
            'Device/regional compatibility FAQ; resolvable autonomously with geographical support '
            'information.'
        ),
        "difficulty": 'routine',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm sorry, the Amazon Alexa app and Echo devices are not currently supported in the Republic of "
            'Ireland. ^SB'
        ),
    },
    {
        "pattern": r"do u i need to pay extra amount to watch movies",
        "message_text": (
            'do u i need to pay extra amount to watch movies or annual subscription is enough for prime '
            'video?'
        ),
        "true_intent": 'prime_subscription_benefits',
        "true_escalate": False,
        "escalate_reason": 'Standard Prime Video benefit inquiry; resolvable autonomously with plan inclusion confirmation.',
        "difficulty": 'routine',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Prime Video streaming is included with your Amazon Prime annual subscription at no extra cost. '
            '^MK'
        ),
    },
    {
        "pattern": r"Tracking says delivered on my porch 2 hours ago",
        "message_text": 'Tracking says delivered on my porch 2 hours ago, but nothing is here.',
        "true_intent": 'delivery_not_received',
        "true_escalate": False,
        "escalate_reason": (
            'False delivery scan buffer; autonomous policy instructs 24-36h wait and check safe spots before '
            'replacing.'
        ),
        "difficulty": 'ambiguous',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Carriers occasionally scan items prematurely. Please check around your porch/mailroom and allow '
            '24 hours. ^VH'
        ),
    },
    {
        "pattern": r"The zipper on this jacket broke after two days",
        "message_text": (
            'The zipper on this jacket broke after two days. The item is defective, can I exchange it or get '
            'a refund?'
        ),
        "true_intent": 'damaged_defective_wrong_item',
        "true_escalate": False,
        "escalate_reason": (
            'Defective item vs return dispute; root cause is defective product, resolvable via free '
            'replacement portal.'
        ),
        "difficulty": 'ambiguous',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm sorry to hear that your jacket is defective! You can request an immediate free replacement "
            'here: https://amazon.com/returns. ^NR'
        ),
    },
    {
        "pattern": r"cheers for automatically taking money from my bank account",
        "message_text": (
            'cheers for automatically taking money from my bank account without any emails to confirm that I '
            'want a prime membership, this money was set aside for my energy bill'
        ),
        "true_intent": 'billing_payment_disputes',
        "true_escalate": True,
        "escalate_reason": 'Unexpected debit affecting critical personal finances; policy mandates human specialist review.',
        "difficulty": 'ambiguous',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm so sorry to hear you were charged unexpectedly! You can cancel your Prime membership here: "
            'https://t.co/o6ilBbTZUV for a full refund. ^JN'
        ),
    },
    {
        "pattern": r"not only do I get charged 3 times for an order, I now get informed it’s going to be late",
        "message_text": (
            'not only do I get charged 3 times for an order, I now get informed it’s going to be late getting '
            'delivered!'
        ),
        "true_intent": 'billing_payment_disputes',
        "true_escalate": True,
        "escalate_reason": (
            'Multi-issue (multiple charges + delivery delay); severe financial dispute takes precedence for '
            'human escalation.'
        ),
        "difficulty": 'multi_issue',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Sorry to hear about this! Please connect directly with our billing team here so we can resolve '
            'both charges: https://t.co/vlvfJr4nN9. ^PK'
        ),
    },
    {
        "pattern": r"order no. 171-3098713-1137162 Is marked as delivered but it is not delivered yet. Pls cancel it and refund",
        "message_text": (
            'order no. 171-3098713-1137162 Is marked as delivered but it is not delivered yet. Pls cancel it '
            'and refund the amount immediately'
        ),
        "true_intent": 'delivery_not_received',
        "true_escalate": True,
        "escalate_reason": (
            'Multi-issue (marked delivered missing + cancellation + refund demand); cannot cancel delivered '
            'order without investigation.'
        ),
        "difficulty": 'multi_issue',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Please share your details here: https://t.co/GIJyeYqKE0 so an investigator can verify delivery '
            'and process a refund. ^HD'
        ),
    },
    {
        "pattern": r"If I wanted my package delivered eventually I wouldn't have paid 100 for prime",
        "message_text": (
            "If I wanted my package delivered eventually I wouldn't have paid 100 for prime. At this point I "
            "really just want a refund on prime because getting 5 dollars doesn't make up for multiple "
            'failures to deliver on promised times'
        ),
        "true_intent": 'customer_service_escalation',
        "true_escalate": True,
        "escalate_reason": (
            'Multi-issue (late delivery + Prime refund demand + rejection of previous agent concession); '
            'requires supervisor handling.'
        ),
        "difficulty": 'multi_issue',
        "thread_context": (
            '[Customer]: Amazon gave me a 5 dollar credit because of my late package | [AmazonHelp]: We '
            'apologize for the shipping delay.'
        ),
        "reference_brand_reply": (
            "I'm sorry for your frustrations! We'd like to have a specialist look into this with you. Please "
            'send us a message here: https://t.co/... ^TR'
        ),
    },
    {
        "pattern": r"what a joke. The most #unhelpful #rude #unprofessional #uncommunicative team",
        "message_text": (
            'what a joke. The most #unhelpful #rude #unprofessional #uncommunicative team I’ve come across. '
            'Who taught you #CustomerService?'
        ),
        "true_intent": 'customer_service_escalation',
        "true_escalate": True,
        "escalate_reason": (
            'Severe service dissatisfaction accusing support reps of rudeness; mandatory human supervisor '
            'escalation.'
        ),
        "difficulty": 'angry_profane',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm sorry to hear that. Without giving any order details publicly, please connect with our "
            'leadership team here: https://t.co/... ^AB'
        ),
    },
    {
        "pattern": r"Your service is completely unacceptable. I am calling my attorney",
        "message_text": (
            'Your service is completely unacceptable. I am calling my attorney and filing a complaint with '
            'the FTC.'
        ),
        "true_intent": 'customer_service_escalation',
        "true_escalate": True,
        "escalate_reason": (
            'Explicit legal and regulatory threat; corporate policy mandates immediate freeze and transfer to '
            'specialized team.'
        ),
        "difficulty": 'angry_profane',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'We take this matter seriously. Please contact our executive relations office directly via: '
            'https://amazon.com/gp/help/contact-us. ^EX'
        ),
    },
    {
        "pattern": r'Amazon can you fucking not\? \"Delivered\" does not mean leave it in the sodding driveway',
        "message_text": (
            "Amazon can you fucking not? 'Delivered' does not mean leave it in the sodding driveway where "
            'anyone can steal it!'
        ),
        "true_intent": 'carrier_physical_delivery_issue',
        "true_escalate": True,
        "escalate_reason": 'Profane complaint regarding unsafe delivery drop placement; requires carrier logistics report.',
        "difficulty": 'angry_profane',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm so sorry about this poor delivery experience! Could you please confirm if you have a safe "
            'place set here: https://t.co/M6rUMOayX7? ^SD'
        ),
    },
    {
        "pattern": r"I noticed an unauthorized charge of \$149\.99 on my Visa",
        "message_text": (
            'I noticed an unauthorized charge of $149.99 on my Visa from your site yesterday. Dispute the '
            'whole charge please!'
        ),
        "true_intent": 'billing_payment_disputes',
        "true_escalate": True,
        "escalate_reason": (
            'Financial fraud allegation; policy strictly prohibits autonomous resolution and demands secure '
            'human verification.'
        ),
        "difficulty": 'high_risk',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Please report this immediately to our secure fraud team here: https://amazon.com/contact-us. Do '
            'not post card numbers publicly. ^CB'
        ),
    },
    {
        "pattern": r"please help\. I can't get into the live chat or any contact us area as your site has locked my account",
        "message_text": (
            "please help. I can't get into the live chat or any contact us area as your site has locked my "
            'account. Who do I contact in UK?'
        ),
        "true_intent": 'account_access_security',
        "true_escalate": True,
        "escalate_reason": (
            'Account locked out preventing normal sign-in; requires Two-Step verification recovery by human '
            'security specialist.'
        ),
        "difficulty": 'high_risk',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "I'm sorry for any inconvenience! Please use our alternate verification recovery form here: "
            'https://t.co/zYVX1Qi29G. ^JP'
        ),
    },
    {
        "pattern": r"your delivery guy in Lincoln park NJ took my friends puppy",
        "message_text": (
            'your delivery guy in Lincoln park NJ took my friends puppy. Need help now!!! Police next call... '
            'Thank you!'
        ),
        "true_intent": 'carrier_physical_delivery_issue',
        "true_escalate": True,
        "escalate_reason": (
            'Critical physical crime allegation involving delivery personnel; requires immediate dispatcher '
            'and human intervention.'
        ),
        "difficulty": 'high_risk',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "We'd like to have a specialist look into this urgently. Please provide details securely here: "
            'https://t.co/... ^EM'
        ),
    },
    {
        "pattern": r"Link\?\?\?",
        "message_text": 'Link???',
        "true_intent": 'other_unclear',
        "true_escalate": False,
        "escalate_reason": 'One-word fragment with zero context; resolvable autonomously by requesting clarification.',
        "difficulty": 'low_signal',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            'Could you please explain what you need assistance with so we can direct you to the right place? '
            '^AG'
        ),
    },
    {
        "pattern": r"team im facing issue on my amazon seller account",
        "message_text": (
            'team im facing issue on my amazon seller account ?? Can u help i already droped mail also still '
            "didn't received any response.."
        ),
        "true_intent": 'other_unclear',
        "true_escalate": False,
        "escalate_reason": (
            'Merchant / Seller Central issue out of consumer customer service scope; resolvable by '
            'redirecting to Seller Central.'
        ),
        "difficulty": 'low_signal',
        "thread_context": 'None (opening turn)',
        "reference_brand_reply": (
            "Our consumer team can't access seller accounts. Please reach out directly to Seller Support at: "
            'https://sellercentral.amazon.com. ^MS'
        ),
    },
]
