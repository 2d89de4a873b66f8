"""Continuous evaluation over streams."""
