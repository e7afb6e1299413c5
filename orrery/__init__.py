"""Orrery: codebase and corpus analytics expressed as Spark DataFrame programs."""
