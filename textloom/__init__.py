"""Preparing, measuring and validating text corpora for language-model work, as Spark DataFrame transformations."""
