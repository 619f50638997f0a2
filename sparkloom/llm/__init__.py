"""Operators for large-scale training-data preparation. Nothing else in sparkloom imports this."""
