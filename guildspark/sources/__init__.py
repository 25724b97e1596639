"""Part of guildspark: sources."""
