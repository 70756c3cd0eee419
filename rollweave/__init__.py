"""Spark-native engine for roll-like registry text: extraction, reconciliation,
scoped fuzzy search, readiness reporting, rule evaluation and text scanning.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here collects rows to the driver.
"""

__version__ = "0.1.0"
