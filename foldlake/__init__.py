"""Foldlake: nucleotide sequence and secondary-structure analytics as Spark DataFrames."""
