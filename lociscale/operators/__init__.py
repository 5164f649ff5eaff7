"""Operators over DataFrames: contracts, joins, ranks, statistics, resampling, linkage, association, ranking."""
