"""lodestrata: a Spark-native engine for knowledge-base search, temporal and graph data.

Every operator is a plain DataFrame-to-DataFrame function.  The subpackage
``llm`` holds the operators for training-data preparation; nothing outside of
it imports it.
"""

__version__ = "0.1.0"
