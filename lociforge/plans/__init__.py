"""Whole analyses: variant callers, concordance and the registered queries."""
