"""Training-data operators: quality, PII, mixing, toxicity, URL rules, licences,
similarity joins, packing.  Nothing outside this package imports it."""
