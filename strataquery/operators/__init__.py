"""Operators over DataFrames; each module states its plan and its defined results."""
