"""Operators: functions of DataFrames and columns, each a plan that Catalyst can optimise."""
