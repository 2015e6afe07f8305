"""lexitally: text counting and run analytics as Spark DataFrame jobs.

Subpackages: ``sources`` (tables, text folders, result CSVs), ``functions``
(tokenisers and scalar helpers), ``operators`` (counts, run analytics, event
attachment, sampling, report), ``plans`` (run-log fixtures, registered
queries with oracle SQL), ``sinks`` (files) and ``streaming`` (Structured
Streaming sources, operators and sinks).
"""

__version__ = "0.1.0"
