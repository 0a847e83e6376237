"""PySpark-native operators for cleaning, masking, counting, sorting and re-sharding activity logs."""
