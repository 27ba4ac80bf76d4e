"""Exact planar geometry on WKT in numpy, without further libraries."""
