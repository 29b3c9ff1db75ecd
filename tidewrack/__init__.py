"""Tidewrack: a PySpark-native analytics engine for collections of public web text."""
