"""Conversation analytics and support triage as Spark DataFrame jobs."""
