"""Readers and writers of the engine's tables."""

from larkspur.sources.readers import first_existing, missing_columns, read_csv, read_csvs, read_json_maps, read_parquet, require_columns  # noqa: F401
from larkspur.sources.writers import append_rows, read_versions, report_csv, save_table, save_version, summary, upsert  # noqa: F401
