"""Nearest-neighbour and relational analytics as Spark DataFrame programs."""
