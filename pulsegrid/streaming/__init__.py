"""Wiring of the live queries."""
