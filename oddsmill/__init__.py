"""Prediction-market analytics written as Spark DataFrame operators."""
