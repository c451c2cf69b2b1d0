"""Composed routes and the registered queries."""
