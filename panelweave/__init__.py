"""panelweave: cross-sectional panel research expressed as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` that can be chained with
``df.transform``.  See README.md for the map of modules.
"""
