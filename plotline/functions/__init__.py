"""Part of plotline: functions."""
