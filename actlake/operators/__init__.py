"""Operators from bulletin pages to acts, tables, citations and listings."""
