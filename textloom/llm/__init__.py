"""Training-data operators: near-dedup, quality, licences, secrets, BPE, search, substring dedup, packing, toxicity.

Nothing outside this subpackage imports it.
"""
