"""Part of the freshet engine."""
