"""tabrig: tabular experiment operators re-expressed as Spark DataFrame jobs.

Every operator is a plain function over DataFrames; nothing is held on the
driver except results whose size is bounded by columns x classes x models.
"""

__version__ = "0.1.0"
