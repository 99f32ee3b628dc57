"""Part of formloom: functions."""
