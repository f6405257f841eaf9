"""PySpark-native planning of utility pipe networks, and operators for large text corpora."""
