"""ledgerline — management analytics for a multi-branch service business on Spark.

Layers: ``sources`` (ingest, flattening, calendar, adapters), ``functions``
(Column -> Column helpers), ``operators`` (marts, reports, planning, quality,
conforming), ``streaming`` (incremental refresh) and ``plans`` (the named query
registry used by ``__spark_entry__``).
"""

__version__ = "0.1.0"
