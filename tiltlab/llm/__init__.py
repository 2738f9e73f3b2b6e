"""Training-data operators: scoring, scans, joins, mixing, extraction, rules, formatting and de-duplication.

Nothing outside this package imports it. ``queries.py`` holds the registered queries and their SQL.
"""
