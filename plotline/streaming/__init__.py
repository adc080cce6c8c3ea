"""Part of plotline: streaming."""
