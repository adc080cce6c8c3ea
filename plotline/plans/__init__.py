"""Part of plotline: plans."""
