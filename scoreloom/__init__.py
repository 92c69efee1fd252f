"""Spark-native evaluation of generated text and of embedding sequences.

Everything here is a function from DataFrames to DataFrames or from Columns to Columns.
Nothing creates a session, and nothing brings rows to the driver.
"""
