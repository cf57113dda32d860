"""Operators over usage, components, prices and costs: DataFrame in, DataFrame out."""
