"""A PySpark-native analytics engine for industrial-controller programs."""
