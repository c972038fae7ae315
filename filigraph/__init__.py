"""Property-graph analytics and data preparation on PySpark.

Nothing is imported here, so that each subpackage can be used (or left out) on its own.
"""
