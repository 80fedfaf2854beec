"""Job-posting intelligence as PySpark DataFrame operators.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers,
normalisers and sinks), ``operators`` (DataFrame in, DataFrame out),
``streaming`` (Structured Streaming jobs) and ``plans`` (the registered
queries with their SQL oracles).
"""
