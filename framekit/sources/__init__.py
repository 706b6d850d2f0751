"""Sources: CSV, Parquet, in-memory frames, catalog tables and JDBC, with type detection."""

from .connect import read_jdbc, write_jdbc
from .csv import load_csv
from .frame import load_frame
from .parquet import load_parquet

__all__ = ["load_csv", "load_frame", "load_parquet", "read_jdbc", "write_jdbc"]
