"""Fibre access network planning on Spark DataFrames."""
