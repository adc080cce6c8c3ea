"""Part of plotline: sources."""
