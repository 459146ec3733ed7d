"""Flock-outcome analytics on Spark DataFrames.

Daily counts of many simulated or observed flocks go in; growth, feed, treatment,
thinning, slaughter and economics per flock and per scenario come out.
"""
