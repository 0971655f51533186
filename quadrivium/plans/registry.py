"""Registered queries of the course-content engine and the SQL they are held against."""

from __future__ import annotations

from . import deadlines, flows, ledger, lifecycle, records, store

QUERIES = ledger.QUERIES | store.QUERIES | deadlines.QUERIES | lifecycle.QUERIES | records.QUERIES | flows.QUERIES
SQL = ledger.SQL | store.SQL | deadlines.SQL | lifecycle.SQL | records.SQL | flows.SQL
