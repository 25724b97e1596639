"""Part of guildspark: operators."""
