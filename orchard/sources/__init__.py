from orchard.sources.tables import table, TABLES  # noqa: F401
