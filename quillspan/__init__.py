"""quillspan: documentation-health analytics expressed as Spark DataFrames."""
