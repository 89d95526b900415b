"""Masked SQL sessions: lineage, gate, rendering."""
