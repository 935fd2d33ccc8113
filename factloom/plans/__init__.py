"""Registered queries: the operators over the given tables, each with SQL that gives the same rows."""
