"""Operators: functions from DataFrames to DataFrames, with domain columns as parameters."""
