"""Part of the table engine: operators."""
