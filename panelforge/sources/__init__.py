from panelforge.sources.io import (
    read_csv, read_json, read_model, read_parquet, write_csv, write_json, write_model, write_parquet,
)
from panelforge.session import scratch_path

__all__ = [
    "read_csv", "read_json", "read_model", "read_parquet", "scratch_path", "write_csv",
    "write_json", "write_model", "write_parquet",
]
