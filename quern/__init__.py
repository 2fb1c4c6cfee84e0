"""Quern: literature retrieval, corpus preparation and their analytics on Spark DataFrames."""
