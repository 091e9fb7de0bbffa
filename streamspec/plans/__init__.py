"""From a checked specification to DataFrames."""
