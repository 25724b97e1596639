"""Part of guildspark: streaming."""
