"""Graph and ordering operators over DataFrames."""
