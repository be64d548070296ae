"""Training-data operators: de-duplication, scoring, packing, mixing, search, formatting.

Each module holds one operator with its general interface (DataFrame in, DataFrame out);
``queries`` registers the thin ``opN_<name>`` queries over the given tables.  Nothing else
in the library imports this sub-package.
"""
