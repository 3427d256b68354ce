"""Training-data operators: cleaning, deduplication, packing and sharding
of large document tables.  Nothing else in the library imports this
subpackage; ``queries.py`` registers its queries."""
