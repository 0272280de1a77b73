"""All core queries and their SQL."""

from __future__ import annotations

from . import archive_ops, data_queries, dataflow, listing, publication, reports, search

QUERIES = {**archive_ops.QUERIES, **listing.QUERIES, **publication.QUERIES, **reports.QUERIES, **search.QUERIES, **dataflow.QUERIES, **data_queries.QUERIES}
SQL = {**archive_ops.SQL, **listing.SQL, **publication.SQL, **reports.SQL, **search.SQL, **dataflow.SQL, **data_queries.SQL}
