"""Training-data operators: extraction, formatting, deduplication, scoring and packing.

Nothing outside this subpackage imports it, so a deployment that only needs the recommendation
features can leave the folder out.
"""
