"""Prepare, evaluate and track machine-learning work on tables of sensor readings.

Every operator takes DataFrames and returns a DataFrame (or a Column), so that
Catalyst plans the whole job and nothing but small summaries reaches the driver.
"""

__version__ = "0.1.0"
