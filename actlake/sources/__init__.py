"""Readers and writers of bulletins, act records and portal records."""
