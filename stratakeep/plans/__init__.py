"""Part of the table engine: plans."""
