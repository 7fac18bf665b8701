"""Operators that stand alone (hash join, ordered map) and data changes as rewrites."""
