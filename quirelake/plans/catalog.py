"""All queries of the library's own operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quirelake.plans import documents, formats, relational, structures

QUERIES: dict = {**relational.QUERIES, **documents.QUERIES, **formats.QUERIES, **structures.QUERIES}
ORACLE_SQL: dict = {**relational.ORACLE_SQL, **documents.ORACLE_SQL, **formats.ORACLE_SQL, **structures.ORACLE_SQL}
