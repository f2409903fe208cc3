"""Operators that prepare text for language-model training.

Nothing else in the package imports this folder. ``queries`` holds the
registered queries, each operator module the SQL of its own.
"""
