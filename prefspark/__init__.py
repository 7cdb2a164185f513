"""prefspark: preference-data construction and evaluation metrics on Spark.

Every operator takes and returns DataFrames. Nothing is collected to the
driver except bounded, aggregate-sized results (a split-point row, a fitted
model's coefficients).
"""

__version__ = "0.1.0"
