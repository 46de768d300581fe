"""Customer-attrition analytics on Spark.

Every operator is a plain function ``DataFrame (+ column names) -> DataFrame``
built on Spark SQL / Spark ML. Sub-packages:

* ``sources``   – reading and writing tables, fixture derivation
* ``functions`` – column expressions and distributed ranking helpers
* ``operators`` – aggregation, profiling, sampling, modelling, scoring
* ``plans``     – the registered query catalogue and its SQL oracles
"""

__version__ = "0.1.0"
