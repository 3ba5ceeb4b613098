"""Checks, mappings, injections, comparisons and the audit trail as DataFrame plans."""
