"""fieldmosaic: small-area estimation from household surveys, on Spark DataFrames."""
