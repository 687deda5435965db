"""Operators for text corpora: tokens, packing, garbled text and formatting duplicates.

Nothing outside this package imports it.
"""
