"""Discussion-forum analytics as PySpark DataFrame functions."""
