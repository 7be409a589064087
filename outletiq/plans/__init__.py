"""Query registry (fixed-parameter plans) and their SQL oracles."""
