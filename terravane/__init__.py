"""Terravane: selection, change and corpus analytics on Spark DataFrames."""
