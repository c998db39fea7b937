"""Analytics over compressed video bitstreams as Spark DataFrames."""
