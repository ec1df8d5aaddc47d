"""Whole plans over corpora."""
