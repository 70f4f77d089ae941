"""Retrieval and analytics over the history of software projects, on Spark DataFrames."""
