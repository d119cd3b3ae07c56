"""Training-data operators: each takes and returns DataFrames and keeps no state between calls."""
