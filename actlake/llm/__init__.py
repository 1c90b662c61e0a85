"""Operators for preparing training data at scale: filtering, de-duplication, tokenising, scoring and packing."""
