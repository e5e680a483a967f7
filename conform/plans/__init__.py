"""Schemas as expressions, and the registered queries."""
