"""Resumable loading of landed feeds."""
