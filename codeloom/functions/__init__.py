"""Part of codeloom: functions."""
