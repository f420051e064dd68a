"""Sparse three-way tensor completion and interval analytics on Spark DataFrames."""
