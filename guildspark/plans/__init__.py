"""Part of guildspark: plans."""
