"""legible — make large, hard-to-read code and text corpora readable on Spark.

Sub-packages:

* ``sources``   — file-tree scans, JSON readers, driver tables, sinks and the resume ledger.
* ``functions`` — scalar ``Column -> Column`` helpers built only on Spark's native expressions.
* ``operators`` — DataFrame operators: extraction, token statistics, mapping resolution,
  packing, inference, heuristics, rewriting and folder planning.
* ``plans``     — end-to-end jobs and the catalogue of registered queries.
* ``streaming`` — incremental (exactly-once, restartable) rewriting with Structured Streaming.
"""

__version__ = "0.1.0"
