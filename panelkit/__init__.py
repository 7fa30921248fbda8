"""panelkit — entity x period panel analytics as plain Spark DataFrame functions.

Every public operator takes DataFrames plus column-name parameters and returns
a DataFrame built from built-in Spark SQL / Spark ML expressions, so Catalyst
plans the whole chain (pushdown, pruning, join strategy) and nothing but small
fitted parameters ever reaches the driver.
"""

__version__ = "0.1.0"
