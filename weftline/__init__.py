"""Grammatical analysis of text and preparation of training data on Spark DataFrames."""
