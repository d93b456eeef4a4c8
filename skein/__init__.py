"""Temporal graph analytics, text resolution and retrieval as plain DataFrame programs."""
