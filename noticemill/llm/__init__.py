"""Operators for preparing training data, with their registered queries."""
