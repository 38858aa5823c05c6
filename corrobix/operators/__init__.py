"""Analytical operators: DataFrame in, DataFrame out."""
