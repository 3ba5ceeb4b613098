"""Column-level building blocks: leaf predicates, dates, keys and code maps."""
