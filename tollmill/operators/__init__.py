"""Relational, analytical, quality and privacy operators over DataFrames."""
