"""Structured-text annotation and audit engine for PySpark."""
