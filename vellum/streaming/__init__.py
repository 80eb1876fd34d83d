"""Structured Streaming: incremental corpus ingest (S1) and chat-turn persistence."""
