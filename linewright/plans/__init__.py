"""Plan helpers: lineage cutting, session settings, iterative joins."""
