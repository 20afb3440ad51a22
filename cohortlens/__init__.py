"""cohortlens: descriptive analytics for encounter-grain tables on Spark.

Profiling, rule-based cleaning, entity sequencing, segment-rate KPIs,
association tests and distribution summaries, each expressed as a
``DataFrame -> DataFrame`` operator built from Spark's own functions.
"""

__version__ = "0.1.0"
