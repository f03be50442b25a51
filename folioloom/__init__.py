"""folioloom: a Spark-first engine for evidence retrieval over page-oriented filings.

Subpackages
-----------
sources    readers, writers, table access and durable intermediate results
functions  pure column expressions and small scalar helpers
operators  DataFrame -> DataFrame operators
plans      end-to-end plans, the query registry and the matching SQL
streaming  Structured Streaming ingestion
llm        operators that prepare training text (nothing else imports it)
"""

__version__ = "0.1.0"
