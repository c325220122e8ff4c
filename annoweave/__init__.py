"""Annotated-dataset analytics as Spark DataFrame operators."""
