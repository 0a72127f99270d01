"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

MESSAGES = (
    "tweet_id long, author_id string, inbound boolean, created_at string, text string, "
    "response_tweet_id string, in_response_to_tweet_id long"
)
PAIRS = (
    "pair_id string, conversation_id string, turn_index int, customer_tweet_id string, brand_tweet_id string, "
    "customer_message string, raw_customer_message string, brand_reply string, raw_brand_reply string, "
    "thread_context string, customer_created_at string, brand_created_at string"
)
PRECEDENTS = (
    "doc_id string, title string, category string, content string, source_url_or_id string, is_policy boolean"
)
GOLD = (
    "id string, message_text string, thread_context string, turn_index int, true_intent string, "
    "true_escalate boolean, escalate_reason string, difficulty string, review_status string, "
    "reference_brand_reply string"
)
GOLD_ALIASES = "query string, expected_intent string, expected_escalate boolean, grounding_doc_ids array<string>"
TURNS = (
    "turn_id string, conversation_id string, author_id string, is_brand_reply boolean, text string, "
    "created_at string, in_reply_to_turn_id string, metadata map<string,string>"
)
JUDGE = (
    "test_id string, grounding_score int, correctness_score int, tone_score int, completeness_score int, "
    "overall_score double, passed boolean, critique string"
)
SOURCES = (
    "array<struct<doc_id:string,category:string,score:double,content:string,title:string,customer_issue:string>>"
)
EVALUATED = (
    "id string, difficulty string, message_text string, thread_context string, true_intent string, "
    "predicted_intent string, intent_correct boolean, confidence double, true_escalate boolean, "
    "predicted_escalate boolean, escalation_correct boolean, escalation_category string, escalate_reason string, "
    f"draft_reply string, grounding_sources {SOURCES}, "
    "judge_evaluation struct<" + JUDGE.replace(" ", ":").replace(",:", ",") + ">"
)
TAXONOMY = (
    "intent_ord int, category string, name string, description string, risk_level string, "
    "requires_human_escalation boolean, example_queries array<string>, resolution_guidance string"
)
