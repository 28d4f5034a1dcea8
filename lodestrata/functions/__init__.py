"""Part of the lodestrata engine."""
