"""textlab: Spark-native labelling, statistics, splitting, features and rule mining for short texts.

Every public function takes and returns DataFrames (or Columns) and leaves physical planning to
Catalyst and AQE; nothing collects row data to the driver.
"""

__version__ = "0.1.0"
