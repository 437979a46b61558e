"""Training-data operators: deduplication, classification, scanning, tokenisation and archives on Spark.

Nothing else in the package imports this subpackage.
"""
