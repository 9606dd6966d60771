"""Query catalogue: what the driver runs, with the same queries as plain SQL."""
