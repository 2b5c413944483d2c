"""Ratios, counts and rankings over keyed event streams, as PySpark DataFrame functions.

Every operator takes a DataFrame and returns a DataFrame, and is used unchanged
on batch and on streaming input.
"""
