"""Training-data operators: quality, near-duplicates, PII, URLs, HTML, tokens, decontamination, packing.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
