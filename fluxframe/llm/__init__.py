"""Training-data operators: language ID, toxicity, mixing, de-duplication, media, tokenizing, licences, search, PII.

Nothing else in the package imports this subpackage; it can be removed without touching the rest.
"""
