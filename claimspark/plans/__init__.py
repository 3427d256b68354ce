"""Registered queries over the test tables (``catalogue``), their DuckDB
oracle SQL (``oracle``) and the fixture views both are built on."""
