"""Training-data operators: quality rules, dedup, mixing, packing, scoring, token files.

The subpackage stands alone: nothing else in the library imports it.
"""
