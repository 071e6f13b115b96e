"""Operators on traces, accesses and bursts."""
