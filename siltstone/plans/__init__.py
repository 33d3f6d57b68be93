"""Plan helpers: shared folders, lineage, connected components."""
