"""File formats read into DataFrames."""
