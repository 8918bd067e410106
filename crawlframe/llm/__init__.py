"""Operators of a training-data pipeline: mixing, joins of near copies, extraction, classifiers, tokenisation."""
