"""Operators: functions from DataFrames to a DataFrame, always lazy unless stated."""
