"""The queries of this subpackage and their SQL."""

from loomcrawl.llm import dac, decontaminate, fixity, jaccard, langid, mainhtml, pieces, pii, prefixcounts, tiff

MODULES = (pii, tiff, jaccard, langid, mainhtml, decontaminate, dac, pieces, fixity, prefixcounts)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
