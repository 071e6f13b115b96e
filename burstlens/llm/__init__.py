"""Operators for preparing training text: see ``queries`` for the registered forms."""
