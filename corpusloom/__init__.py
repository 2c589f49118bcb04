"""Governed-corpus analytics as plain Spark plans: every operator takes and returns DataFrames."""
