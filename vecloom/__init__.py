"""vecloom: a PySpark-native vector collection engine.

Collections of vectors with typed metadata, exact and approximate k-nearest-neighbour search,
an ordered mutation log folded by DataFrame aggregation or Structured Streaming, tiered
compaction, binary vector-file readers and recall evaluation.
"""
