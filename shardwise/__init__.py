"""Federated training and evaluation of tabular classifiers as Spark jobs.

Clients are a column, models and metrics are tables.
"""
