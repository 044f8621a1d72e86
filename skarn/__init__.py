"""Reconciliation of document collections, and corpus preparation, on Spark DataFrames."""
