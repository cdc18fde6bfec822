"""quillspark: ledger-style analytics expressed as Spark DataFrames."""
