"""Operators for training-data preparation on tables of documents."""
