"""Operators of a training-data pipeline: filtering, duplicates, decontamination, tokens."""
