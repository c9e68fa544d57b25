"""Pipelines and state machines composed of operators."""
