"""Colinear: sequence comparison, interval algebra and synteny on Spark DataFrames."""
