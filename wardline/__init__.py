"""A PySpark-native analytics engine for fleets of care-room sensors."""
