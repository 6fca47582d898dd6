"""Operators for preparing training data, each a DataFrame-to-DataFrame function.

Every operator accepts null values in any column, empty and very long texts, repeated rows, empty tables and
extra columns; each module's docstring states the result in those cases.
"""
