"""All registered queries: name -> (query, SQL twin or None)."""

from rapport.plans import catalog_ledger, catalog_search, catalog_sources

QUERIES = {**catalog_ledger.QUERIES, **catalog_search.QUERIES, **catalog_sources.QUERIES}
