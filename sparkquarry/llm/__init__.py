"""Operators for training-data pipelines; nothing else in sparkquarry imports this subpackage."""
