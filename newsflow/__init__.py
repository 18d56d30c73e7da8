"""Newsflow: article pipelines as Spark DataFrame operators."""
