"""Declared rules from a folder of JSON files. Folders and files that are missing declare nothing."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from snapledger.storage import exists, list_children

# The sub-folders of a configuration and what their files declare.
FOLDERS = {
    "schemas": "schemas",                    # {"tables": {table: {"columns": {...}, "derived": {...}}}}
    "column_mappings": "mappings",           # {table: {"id_fields": [...], ...}}
    "table_rules": "rules",                  # {"foreign_keys": {table: {column: {...}}}}
    "display_preferences": "views",          # {table: {"visible_columns": [...], ...}}
}


@dataclass
class Config:
    schemas: dict = field(default_factory=dict)
    mappings: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)
    views: dict = field(default_factory=dict)

    def mapping(self, table: str) -> dict | None:
        return self.mappings.get(table)

    def view(self, table: str) -> dict | None:
        return self.views.get(table)

    def columns(self, table: str) -> dict[str, dict]:
        return self.schemas.get("tables", {}).get(table, {}).get("columns", {})

    def derived(self, table: str) -> dict[str, str]:
        """Columns declared as SQL expressions next to the stored ones."""
        return self.schemas.get("tables", {}).get(table, {}).get("derived", {})


def merged(left: dict, right: dict) -> dict:
    """Declarations of two files together; where both say something, the later file counts."""
    result = dict(left)
    for key, value in right.items():
        both = isinstance(value, dict) and isinstance(result.get(key), dict)
        result[key] = merged(result[key], value) if both else value
    return result


def read_config(spark: SparkSession, root: str | None) -> Config:
    """All JSON files of the four sub-folders, in order of name."""
    config = Config()
    if not root or not exists(spark, root):
        return config
    for name, folder, is_folder in list_children(spark, root):
        if not is_folder or name not in FOLDERS:
            continue
        for file_name, path, _ in list_children(spark, folder):
            if file_name.endswith(".json"):
                text = spark.read.text(path, wholetext=True).first()
                part = FOLDERS[name]
                setattr(config, part, merged(getattr(config, part), json.loads(text[0]) if text else {}))
    return config
