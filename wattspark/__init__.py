"""wattspark: household electricity analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, windows, aggregates and MLlib, so Catalyst plans, prunes and
pushes down the whole chain.
"""

__version__ = "0.1.0"
