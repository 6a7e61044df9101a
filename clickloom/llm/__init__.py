"""Training-data operators: cleaning, joins, mixing and output of text corpora."""
