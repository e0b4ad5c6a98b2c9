"""Text analytics on Spark: corpora, lexicons, n-gram models, transliteration and suggestion."""
