from marquee.sources.tables import read_table, load_tables  # noqa: F401
