"""siltstone: a PySpark-native engine for crawled web data and the text corpora built from it."""
