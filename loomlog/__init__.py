"""loomlog: conversation-log analytics and training-data preparation on Spark.

Sub-packages
------------
functions   column expressions (instants, ASCII folding, clipping, ...)
operators   record-level data processing (shredding, drift, de-duplication, ledger)
sources     log readers (offset-preserving JSONL batch and stream source)
plans       the read queries over event tables (search, timeline, sessions, ...)
streaming   tailing logs
llm         operators for training text; optional, nothing else imports it
"""

__version__ = "0.1.0"
