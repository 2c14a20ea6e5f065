"""Training-data operators: filters, formatting, classifiers, packing, joins, search and deduplication of texts.

``catalog.load()`` returns the registered queries of this subpackage and their SQL twins.
"""
