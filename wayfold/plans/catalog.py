"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from wayfold.plans import business, fleet, history, journeys, network, streams, trackbook

BOOKS = (network.book, fleet.book, trackbook.book, business.book, history.book, journeys.book, streams.book)
QUERIES: dict = {name: make for b in BOOKS for name, make in b.queries.items()}
ORACLE_SQL: dict[str, str] = {name: text for b in BOOKS for name, text in b.sql.items()}
