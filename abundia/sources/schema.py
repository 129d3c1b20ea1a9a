"""Declared schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_text, _real, _whole, _flag = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]

ABUNDANCE = _struct(("entity", _text), ("site", _text), ("abundance", _real))
ANNOTATION = _struct(("entity", _text), ("gene_id", _text), ("marker", _text))
PATHWAY = _struct(("entity", _text), ("pathway", _text), ("score", _real))
MARKER = _struct(("metabolism", _text), ("gene", _text), ("marker", _text))
OVERRIDE = _struct(("entity", _text), ("trait", _text), ("value", _flag))
TAXON_RULE = _struct(("rank", _text), ("taxon", _text), ("trait", _text), ("value", _flag))
TRAIT = _struct(("entity", _text), ("trait", _text), ("kind", _text), ("value", _flag))
MEMBERSHIP = _struct(("entity", _text), ("community", _text), ("cluster", _flag))
EDGE = _struct(("node", _whole), ("parent", _whole), ("length", _real), ("label", _text))
QUALITY = _struct(
    ("entity", _text), ("completeness", _real), ("contamination", _real),
    ("gc", _real), ("n50", _whole), ("size", _whole),
)
ENTITY = T.StructType(
    [T.StructField("entity", _text), T.StructField("name", _text)]
    + [T.StructField(rank, _text) for rank in RANKS]
    + QUALITY.fields[1:]
)
