"""Operators of the memory engine: functions from DataFrames to DataFrames."""
