"""Termloom: lexical retrieval, term weighting and text-corpus operators on Spark DataFrames."""
