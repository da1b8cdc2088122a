"""Corvane: retrieval, evaluation and training-data operators on PySpark DataFrames.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame), ``sources`` (readers and sinks),
``plans`` (registered queries with their SQL), ``streaming`` (Structured Streaming jobs) and the optional ``llm``
(training-data operators, which nothing here imports).
"""
