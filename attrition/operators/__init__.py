"""Operators: aggregation, cleaning, ratios, profiling, sampling, modelling, scoring."""
