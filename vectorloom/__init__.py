"""vectorloom: embedding-table compression, text encoding, ranking and retrieval
metrics as Spark DataFrame jobs.

Layout:
  functions/  column expressions (vector algebra, bit packing, fixed levels)
  operators/  DataFrame -> DataFrame operators (quantize, learn, text, rank, ...)
  sources/    readers and writers (TREC files, JSONL corpora, model tables)
  plans/      compositions: compression pipelines, evaluation plans, query registry
  streaming/  Structured Streaming corpus pass (running top-K, quantize on arrival)
"""

__all__ = ["session"]
