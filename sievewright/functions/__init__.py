"""Column builders: leaf predicates, comparison for change detection, and row shapes."""
