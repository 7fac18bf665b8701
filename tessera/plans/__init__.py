"""Syntax trees, parser, resolver and the cost model."""
