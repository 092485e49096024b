"""Training-data operators: packing, deduplication, token files, WARC, chat masks, language ID and mixing.

Nothing outside this subpackage imports it.
"""
