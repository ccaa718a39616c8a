"""Operators over observation frames: DataFrame in, DataFrame out."""
