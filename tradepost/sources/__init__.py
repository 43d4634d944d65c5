from .adapter import shop_tables
from .reader import Tables, load
from .schema import TABLES, ForeignKey, TableSpec

__all__ = ["TABLES", "ForeignKey", "TableSpec", "Tables", "load", "shop_tables"]
