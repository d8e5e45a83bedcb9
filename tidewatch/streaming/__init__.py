"""Structured Streaming forms of the evaluation, strike and dialog operators."""
