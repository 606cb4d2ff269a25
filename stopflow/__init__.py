"""Transit-operations analytics as plain PySpark DataFrame functions."""
