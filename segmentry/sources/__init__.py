"""Landed feeds and tables."""
