"""All queries over the test tables, by name, with the SQL that checks them."""

from __future__ import annotations

from . import domain, landed, relational

QUERIES = {**relational.QUERIES, **domain.QUERIES, **landed.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **domain.ORACLE_SQL, **landed.ORACLE_SQL}
