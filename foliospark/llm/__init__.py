"""Training-data operators: token counts, dedup, language id, decontamination, packing.

Nothing outside this subpackage imports it.
"""
