"""Part of the table engine: sources."""
