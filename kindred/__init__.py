"""Audience expansion and corpus preparation on Spark DataFrames."""
