"""DuckDB SQL for those queries that SQL can express."""

ORACLES: dict[str, str] = {}
