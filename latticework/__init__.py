"""Array containers, their catalogs and their workloads as Spark DataFrames."""
