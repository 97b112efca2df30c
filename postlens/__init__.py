"""Labour-market analytics as plain PySpark DataFrame functions."""
