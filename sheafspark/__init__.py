"""sheafspark: documents and tables in, page, block, span and cell DataFrames out."""
