"""Gridded time-series analytics (time x latitude x longitude) on Spark DataFrames."""
