"""Table sources: driver tables, fact stand-ins, catalog helpers."""
