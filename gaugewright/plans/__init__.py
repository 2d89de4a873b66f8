"""Whole jobs: evaluation, experiments, comparison, model calls, and the registered queries."""
