"""strata: document-evidence analytics as Spark jobs.

Layers: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame),
``sources``/``sinks`` (readers and writers), ``plans`` (end-to-end jobs),
``streaming`` (Structured Streaming jobs) and ``catalog`` (registered queries + oracles).
"""

__version__ = "0.1.0"
