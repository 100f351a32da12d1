"""Sparkloom: relational exploration and corpus processing on PySpark."""
