"""Operators for large training-data pipelines.

Every operator takes and returns DataFrames.  Unless its docstring says
otherwise it reads only the columns it names, ignores all others (so extra or
clashing columns are harmless), answers one row per input row (repeated rows
are answered repeatedly), and returns an empty frame for an empty table.
"""
