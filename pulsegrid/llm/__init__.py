"""Operators for training data; nothing else in the library imports this subpackage."""

#: Modules with QUERIES and SQL.
QUERY_MODULES = ["pulsegrid.llm.record_queries", "pulsegrid.llm.text_queries"]
