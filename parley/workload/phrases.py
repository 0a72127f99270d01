"""Support phrases of our own, laid over the given tables so that every rule has rows to work on."""

from __future__ import annotations

# (label, phrase)
PHRASES = [
    ("delivery_not_received", "my parcel was marked delivered this morning"),
    ("delivery_not_received", "it says delivered but I did not receive anything"),
    ("order_status_delay", "it was supposed to be delivered monday and I have not receive a call"),
    ("delivery_not_received", "the porch camera shows nothing was left"),
    ("delivery_not_received", "I haven't received my package yet"),
    ("order_status_delay", "Where is my parcel"),
    ("order_status_delay", "it is preparing for shipment since friday"),
    ("order_status_delay", "when will it actually ship"),
    ("order_status_delay", "when is this going to be dispatched"),
    ("order_status_delay", "I ordered shoes 5 days ago and the status has not moved"),
    ("order_status_delay", "please tell me the order status"),
    ("order_status_delay", "this was supposed to arrive yesterday"),
    ("order_status_delay", "the parcel hasn't arrived and is running late"),
    ("order_status_delay", "when will my headphones arrive"),
    ("order_status_delay", "the estimated delivery keeps moving"),
    ("order_status_delay", "paid for one day shipping and it took three days"),
    ("returns_refunds", "I need a refund for this"),
    ("returns_refunds", "how do i return these boots"),
    ("returns_refunds", "please send me a return label"),
    ("returns_refunds", "my money is not refunded after a month"),
    ("returns_refunds", "i want my refund now"),
    ("damaged_defective_wrong_item", "the mug came broken and cracked"),
    ("damaged_defective_wrong_item", "you sent the wrong size"),
    ("damaged_defective_wrong_item", "poor quality and the zipper broke on day one"),
    ("billing_payment_disputes", "I was charged twice for one item"),
    ("billing_payment_disputes", "there is an unauthorized charge on my card"),
    ("billing_payment_disputes", "you are automatically taking money from my bank account"),
    ("billing_payment_disputes", "why does my credit card show a charge"),
    ("billing_payment_disputes", "payment declined again"),
    ("account_access_security", "i am locked out since monday"),
    ("account_access_security", "someone hacked me"),
    ("account_access_security", "the otp never comes"),
    ("account_access_security", "i can't log in at all"),
    ("carrier_physical_delivery_issue", "the delivery driver was rude to my mother"),
    ("carrier_physical_delivery_issue", "he threw the box over the fence"),
    ("carrier_physical_delivery_issue", "my ring doorbell filmed everything"),
    ("carrier_physical_delivery_issue", "they left it in the rain"),
    ("order_cancellation_modification", "please cancel my order"),
    ("order_cancellation_modification", "change my delivery address"),
    ("order_cancellation_modification", "i am not able to cancel"),
    ("customer_service_escalation", "this is the worst customer service"),
    ("customer_service_escalation", "let me speak to supervisor"),
    ("customer_service_escalation", "my lawyer will write to you"),
    ("customer_service_escalation", "your customer service sucks"),
    ("prime_subscription_benefits", "prime video keeps buffering"),
    ("prime_subscription_benefits", "is the annual subscription worth it"),
    ("prime_subscription_benefits", "i only want to watch movies"),
    ("product_inquiry_availability", "when do y'all restock these shoes"),
    ("product_inquiry_availability", "is this case compatible with my phone"),
    ("product_inquiry_availability", "when will the blue one be available"),
    ("returns_refunds", "I want a refund and the delivery driver was late"),
    ("billing_payment_disputes", "charged twice and the item hasn't shipped"),
    ("returns_refunds", "where is my refund"),
    ("other_unclear", "good morning everyone"),
    ("other_unclear", "what do you think about this"),
    ("other_unclear", "?"),
    ("other_unclear", "help"),
    ("other_unclear", "Link???"),
    ("other_unclear", "dm"),
    ("other_unclear", "thinking of sunday and a cup of tea"),
    ("other_unclear", "my amazon seller account has a problem"),
    ("billing_payment_disputes", "i think this is fraud"),
    ("account_access_security", "someone used a stolen password"),
    ("carrier_physical_delivery_issue", "the police are here"),
    ("customer_service_escalation", "i will sue you"),
    ("billing_payment_disputes", "a fraudulent charge appeared on my statement"),
    ("account_access_security", "my account hacked yesterday"),
    ("order_status_delay", "next day delivery delayed and nobody answers"),
    ("order_status_delay", "one day shipping again delayed"),
    ("delivery_not_received", "delivered to a neighbour please refund the amount"),
    ("delivery_not_received", "this is fucking not fine it was never delivered"),
    ("returns_refunds", "my money is not refunded in six weeks"),
    ("returns_refunds", "cashback missing for two months"),
    ("damaged_defective_wrong_item", "you fooled me with that battery"),
    ("billing_payment_disputes", "charged 3 times for the same box"),
    ("prime_subscription_benefits", "do u i need to pay extra to see movies"),
    ("prime_subscription_benefits", "is prime video available on my tv"),
    ("prime_subscription_benefits", "music unlimited on how many devices"),
    ("prime_subscription_benefits", "why does prime member here not give me music"),
    ("account_access_security", "you locked my account"),
    ("account_access_security", "password assistance mail every hour"),
    ("account_access_security", "my recovery phone is gone"),
    ("carrier_physical_delivery_issue", "he threw the parcel and my puppy ran off"),
    ("carrier_physical_delivery_issue", "the delivery guy was rude so here is a complaint"),
    ("order_cancellation_modification", "cancel my order immediately"),
    ("order_cancellation_modification", "how do i cancel my order"),
    ("customer_service_escalation", "i want to speak to a manager now"),
    ("customer_service_escalation", "what a joke the worst team i've come across"),
    ("other_unclear", "Dauerschleife am Sonntag für alle schönen Übergrößen"),
    ("other_unclear", "сколько это стоит и когда приедет"),
    ("order_status_delay", "Where is my package? The tracking number is TRK-88219"),
    ("returns_refunds", "How do I return a dress that doesn't fit"),
    ("returns_refunds", "can I exchange it within 30 days or return it by mail"),
    ("order_status_delay", "the tracking status has no link and I track it daily"),
    ("damaged_defective_wrong_item", "a different item came and the driver left"),
    ("customer_service_escalation", "the service is useless I demand attention"),
    ("other_unclear", "just relaxing on the sofa"),
]

# Appended to phrases; "{n}" becomes a customer key.
TAILS = [
    " note n{n}",
    "",
    " order #12345",
    " ref 405-4841727-8482714",
    " mail me at jo.doe@mail.example.org",
    " call 555-867-5309",
    " see https://example.com/t/123?x=1",
    "   @SomeShop   please",
    " tracking: abc-12x9",
    " www.example.org/help now",
    " thanks a lot ^AB",
]

# Brand replies; "{n}" becomes one of REPLY_KEYS numbers.
REPLY_KEYS = 350
REPLIES = [
    "Case {n}: you can track your parcel under Your Orders at https://example.com/orders. ^AM",
    "@Customer1 We are sorry to hear that! Please allow 24 hours for the scan to update. ^VH",
    "Case {n}: returns are free within 30 days, print the label in the returns center. ^CS",
    "You can request a replacement or a refund in the returns center.",
    "Case {n}: please contact our billing team so that we can check the charge. ^PK",
    "Please never share your password or any code in public. ^JP",
    "Case {n}: prime video is included in the annual subscription. ^MK",
    "Thanks!",
    "Case {n}: you can cancel the order before dispatch under Your Orders. ^TR",
    "We have passed your report about the driver to the carrier. ^EM",
    "Case {n}: add the item to your wishlist and we will tell you when it is in stock. ^SB",
    "Could you tell us a little more, so that we can point you to the right place? ^AG",
    "Case {n}: help is on the way, the delivery guy will call within 2 days.",
]
