"""Operators: functions from DataFrames to DataFrames, and column expressions that they share."""
