"""Flood-relief planning and corpus preparation as Spark DataFrame operators."""
