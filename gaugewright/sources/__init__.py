"""Readers and writers of evaluation tables."""
