"""Page-to-table jobs on Spark: page text, links, listings, usage and similarity."""
