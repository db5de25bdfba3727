"""Declarative chains of operators."""
