"""Operators built on DataFrames: rules, dataset idioms, series and sampling, the SQL service."""
