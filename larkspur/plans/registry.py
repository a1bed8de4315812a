"""All registered queries, with SQL that gives the same rows."""

from __future__ import annotations

from larkspur.plans import enrichment, market, reports, roundtrips, streams, trips

QUERIES, ORACLE_SQL = {}, {}
for _module in (trips, market, enrichment, reports, roundtrips, streams):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
