"""walkloom: variation-graph analytics on Spark DataFrames, many loci at once."""
