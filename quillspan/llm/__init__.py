"""Operators of a training-data pipeline over document tables; nothing else in the library imports this package."""
