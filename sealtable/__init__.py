"""Analytics over encrypted tables, written as ordinary Spark jobs."""

from sealtable.operators.keyring import Keyring
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

__all__ = ["Keyring", "read_table", "write_table"]
