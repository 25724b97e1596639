"""Part of guildspark: functions."""
