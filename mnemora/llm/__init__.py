"""Operators of a training-data pipeline: chat formatting, deduplication,
token counts, classifiers, decontamination and mixing.

Nothing else in the library imports this subpackage.
"""
