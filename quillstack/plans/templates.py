"""Texts of new scripts, in Spark's SQL, chosen by the beginning of the script's name."""

from __future__ import annotations

import re
from datetime import datetime

from ..errors import FileFailed, ValidationFailed
from ..functions.strings import IRREGULAR
from ..functions.times import zone_of

def sanitized(name: str) -> str:
    """functions.strings.sanitized_name for the driver."""
    s = re.sub(r"[ _-]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", name).lower()).strip("_")
    s = re.sub("[^a-zA-Z0-9_]", "", s)
    return f"migration_{s}" if s[:1].isdigit() else s


def plural(word: str) -> str:
    """functions.strings.plural for the driver."""
    w = word.lower()
    if not w or w in IRREGULAR:
        return IRREGULAR.get(w, w)
    if re.search(r"[^aeiou]y\Z", w):
        return w[:-1] + "ies"
    if re.search(r"(s|sh|ch|x|z)\Z", w):
        return w + "es"
    return w[:-1] + "ves" if w.endswith("f") else w[:-2] + "ves" if w.endswith("fe") else w + "s"


def table_of(name: str) -> str:
    t = name.removeprefix("create_").removesuffix("_table")
    return t if t.endswith("s") else plural(t)


def script_text(name: str, at: datetime) -> str:
    if name.startswith("create_"):
        t = table_of(name)
        up = f"CREATE TABLE {t} (\n    id STRING,\n    created_at TIMESTAMP,\n    updated_at TIMESTAMP,\n    deleted_at TIMESTAMP\n) USING parquet;"
        down = f"DROP TABLE IF EXISTS {t};"
    elif name.startswith("add_"):
        up, down = "-- ALTER TABLE some_table ADD COLUMN some_column STRING;", "-- Rebuild some_table without some_column: parquet tables can't drop columns."
    elif name.startswith("drop_"):
        up, down = "-- Rebuild some_table without some_column: parquet tables can't drop columns.", "-- ALTER TABLE some_table ADD COLUMN some_column STRING;"
    else:
        up, down = "-- What the script does goes here.", "-- What takes it back goes here."
    return f"-- Script: {name}\n-- Made: {at:%Y-%m-%d %H:%M:%S}\n\n-- +migrate Up\n{up}\n\n-- +migrate Down\n{down}\n"


def write_script(folder: str, name: str, zone: str = "UTC", at: datetime | None = None) -> str:
    """Writes a new script; returns its path. An existing file isn't overwritten."""
    clean = sanitized(name)
    if not clean:
        raise ValidationFailed("No script can have this name", name)
    at = at or datetime.now(zone_of(zone))
    path = f"{folder.rstrip('/')}/{at:%Y_%m_%d_%H%M%S}_{clean}.sql"
    try:
        with open(path, "x", encoding="utf-8", newline="\n") as f:
            f.write(script_text(clean, at))
    except OSError as e:
        raise FileFailed("The new script can't be written", str(e)) from e
    return path
