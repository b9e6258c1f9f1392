"""Document structuring on Spark DataFrames: tables of long documents in, outlines, chunks and links out."""
