"""Training-data operators: packing, language ID, dedup, token stores, chat, quality, decontamination.

Nothing outside this subpackage imports it.
"""
