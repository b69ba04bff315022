"""PySpark-native analytics over on-chain and coin-market records."""
