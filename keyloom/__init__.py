"""Bulk analytics over keyed, typed values, expressed as PySpark DataFrames."""
