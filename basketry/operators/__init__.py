"""Miners, rules, indexes, counters, similarities and recommenders over DataFrames."""
