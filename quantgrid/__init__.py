"""Quantification tables as lazy Spark DataFrames: import, quality control, normalization, imputation, evaluation."""
