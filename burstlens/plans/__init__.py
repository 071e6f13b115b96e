"""Whole queries: detection and reports."""
