"""Operators of a training-data pipeline, each with its own query in ``queries``."""
