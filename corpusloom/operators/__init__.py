"""Set-oriented operators over DataFrames."""
