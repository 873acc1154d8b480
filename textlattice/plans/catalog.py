"""Registered queries of the library's own operators, and their SQL."""

from textlattice.plans import conversion, counts, decoding, phrases, training, users, web

PARTS = [web, counts, phrases, users, decoding, training, conversion]
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE: dict = {k: v for p in PARTS for k, v in p.ORACLE.items()}
