"""tessera: layer-oriented spatial and statistical analytics on Spark DataFrames."""
