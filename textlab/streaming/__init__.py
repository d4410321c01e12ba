"""Structured Streaming jobs: label arriving files, running statistics, progress ledger."""
