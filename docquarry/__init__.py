"""Turn stored web pages into searchable vector collections with Spark DataFrames."""
