"""Operators of a training-data pipeline over text corpora.

Each module holds one operator with its own general interface; ``queries``
registers the thin queries over the test tables and their SQL.
"""
