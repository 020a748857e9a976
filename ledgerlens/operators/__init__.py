"""The analyses, grouped by business family.

Each is a function of DataFrames that returns a lazy DataFrame (or a dict of
them); "today" is the explicit ``as_of`` keyword where the analysis needs it.
"""
