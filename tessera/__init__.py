"""Spatio-temporal analytics on Spark: versioned objects, bitemporal facts, relations, geometry.

``tessera.session.Tessera`` is the facade; the packages below hold the operators as plain
functions from DataFrames to DataFrames.
"""
