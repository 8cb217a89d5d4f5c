"""Operators over listing tables: predicates, pages, facets, statistics, search, merge, alerts, exports."""
