"""Conversation analytics as DataFrame operators and streaming queries."""
