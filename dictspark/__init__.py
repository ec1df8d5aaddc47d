"""Dictionary-based text analysis on Spark: checking, analysing, expanding and correcting columns of words."""
