"""Structured Streaming: running pipelines, stateful operators, retries and alerts."""
