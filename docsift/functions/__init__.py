"""Column-level building blocks: expressions that stay inside one row."""
