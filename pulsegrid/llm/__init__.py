"""Training-data operators: quality rules, token counts, chat formatting, URL
filters, source mixing, secret scans, near-duplicate detection, toxicity,
benchmark decontamination and licence scans.

Nothing else in the library imports this subpackage.
"""
