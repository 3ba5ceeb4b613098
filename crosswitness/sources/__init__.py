"""Readers and writers: studies, issue reports, inventories, manifests."""
