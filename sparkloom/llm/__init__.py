"""Training-data operators: extraction, dedup, scoring, fingerprints, token files and mixing.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` derives the contract queries ``opN_<name>`` from them.
"""
