"""bitloom: codelength analytics over label rasters, on Spark."""
