"""Relational and nearest-neighbour operators."""
