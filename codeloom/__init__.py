"""codeloom: a Spark-first engine for the structure of source code and for text corpora."""
