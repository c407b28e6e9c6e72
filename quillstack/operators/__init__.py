"""Operators: functions of DataFrames and parameters to DataFrames, a module for each family."""
