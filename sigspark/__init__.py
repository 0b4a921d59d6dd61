"""Spark jobs over radio captures: catalogues, windows, features, decisions, metrics, streams."""
