"""lociforge: aligned reads, genomic intervals and variant calls as Spark DataFrames.

Coordinates are 0-based and half-open everywhere. Every public function takes and returns
DataFrames (or Columns) and stays lazy; nothing collects data to the driver.
"""

__version__ = "0.1.0"
