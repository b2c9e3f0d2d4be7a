"""Training-data operators: each module holds one operator and takes and returns DataFrames."""
