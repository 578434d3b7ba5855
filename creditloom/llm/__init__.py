"""Operators for preparing training text: packing, coding, scoring, near duplicates, leaks, personal data, pages.

Nothing else in the library imports this package; it uses the library's general helpers only.
"""
