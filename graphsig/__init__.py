"""graphsig: SimHash sketches of graphs, edge streams and texts on Spark DataFrames."""

__version__ = "0.1.0"
