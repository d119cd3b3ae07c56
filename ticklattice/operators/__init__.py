"""Operators: plain functions from DataFrame to DataFrame, one shuffle per key wherever windows share it."""
