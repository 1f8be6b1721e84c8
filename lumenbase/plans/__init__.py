"""Registered queries: views over the tables, one query and one SQL text for each operator."""
