"""Corpus preparation for language-model training: near copies, packing, mixing, quality, language and secrets.

Nothing outside this package imports it.
"""
