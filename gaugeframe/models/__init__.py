"""Regression models on flattened sequences, fitted and scored with Spark ML."""
