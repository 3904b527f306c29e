"""sievekit: digest analytics on Spark.

Scan file trees or tables, decode containers, digest, compare, match, format,
all as DataFrame plans.  ``sievekit.llm`` (optional) adds operators for
training-data pipelines; nothing outside that folder imports it.
"""

__version__ = "0.1.0"
