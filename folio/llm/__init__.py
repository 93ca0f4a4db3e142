"""Operators for training-data preparation: chat formatting, fingerprints, scoring, packing, filtering, mixing.

Nothing else in the library imports this subpackage. Each operator has a general interface in
its own module; :mod:`folio.llm.queries` applies each to its whole table.
"""
