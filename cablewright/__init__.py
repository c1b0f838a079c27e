"""A PySpark-native engine for cable-network design: geometry, topology, cost and routing on DataFrames."""
