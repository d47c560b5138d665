"""Training-data operators: language ID, decontamination, chat formatting, LM
scoring, near-duplicates, line dedup, binary output, BPE (words and bytes), URL
filters, vector codes and periodic runs.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator and ``oracle`` holds the DuckDB SQL of those SQL can express.
"""
