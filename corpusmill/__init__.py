"""Corpus analytics on Spark: generate, curate, sample, pack and evaluate text corpora as DataFrame plans."""
