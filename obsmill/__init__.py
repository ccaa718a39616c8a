"""Spark DataFrame operators for sparse statistical observations.

An observation frame holds one value per row: Area, Item, Element, Year, Unit,
Value, and whatever other columns the source carries.  Two rules hold
everywhere: a missing value is never zero, and an aggregate over partial
coverage is reported as missing.
"""
