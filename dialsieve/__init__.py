"""dialsieve: Spark-native contact-list hygiene.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, joins, aggregates and windows.  Dates, thresholds, batch ids and
toggles are arguments, so a plan is deterministic and can be re-run after a
failure with the same result.
"""

__version__ = "0.1.0"
