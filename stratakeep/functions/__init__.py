"""Part of the table engine: functions."""
