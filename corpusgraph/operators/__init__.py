"""Operators: functions of DataFrames, lazy unless they say otherwise."""
