"""Part of plotline: operators."""
