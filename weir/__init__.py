"""weir: batch analytics over text, sensor-style readings and link graphs, declared as Spark DataFrames."""
