"""Head-to-head contest analytics as PySpark DataFrame operators."""
