"""Point-cloud and scene analytics on DataFrames."""
