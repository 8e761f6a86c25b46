"""Operators of a training-data pipeline: media, text, token and url work.

Nothing outside this subpackage imports it. Each module holds one operator
with a general interface; `queries` holds the thin registered queries.
"""
