"""Scalar functions, aggregates and key codecs as Spark columns."""
