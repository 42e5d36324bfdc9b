"""Quireline: document segmentation, checking and translation memory on Spark DataFrames."""
