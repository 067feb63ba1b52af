"""Operators for preparing training corpora: packing, de-duplication, scoring, mixing and binary output.

Nothing else in the library imports this subpackage.
"""
