"""Part of the table engine: streaming."""
