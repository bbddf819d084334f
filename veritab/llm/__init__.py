"""Operators for preparing training text: filters, deduplication, decontamination and tokenization.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and column names,
keeps its own helper columns inside structs it builds itself (so extra columns of the input can't clash),
and returns a DataFrame.
"""
