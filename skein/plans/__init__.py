"""Helpers that shape how plans run: scratch tables, salting."""
