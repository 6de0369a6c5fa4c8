"""Veil: sensitive-data detection and anonymization on Spark DataFrames."""
