"""Query catalogue: every registered query and its SQL."""
