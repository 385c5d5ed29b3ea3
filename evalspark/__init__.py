"""evalspark — benchmark-evaluation jobs as Spark DataFrame transformations.

Sub-packages: ``functions`` (column-expression builders), ``operators``
(DataFrame -> DataFrame jobs), ``sources`` (readers/writers), ``streaming``
(Structured Streaming jobs), ``plans`` (stand-in queries over the driver
tables plus their DuckDB oracle text).
"""

__version__ = "0.1.0"
