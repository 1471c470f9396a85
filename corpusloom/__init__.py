"""Corpusloom: document-corpus analytics on Spark DataFrames."""
