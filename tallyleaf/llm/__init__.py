"""Training-data operators: tokens, language, packing, archives, URLs, chat, quality, duplicates.

Nothing else in the library imports this subpackage.
"""
