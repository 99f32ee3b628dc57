"""Operators for training-data pipelines; nothing else in formloom imports this subpackage."""
