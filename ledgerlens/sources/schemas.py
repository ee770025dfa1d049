"""The store of XML schemas beside the engine: its registry, and whether its files are what the registry says."""

from __future__ import annotations

import json
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "schema_id string, root string, namespace string, extensions array<string>, path string, sha256 string, source_url string"


class Refused(ValueError):
    """The registry can't be used."""


def check_url(url: str, hosts: set[str]) -> None:
    """Raises Refused unless url is https, without credentials or a port of its own, on a host that is allowed."""
    parts = urlsplit(url)
    if parts.scheme != "https" or parts.username or parts.password or parts.port not in (None, 443) or (parts.hostname or "") not in hosts:
        raise Refused(f"the address is not allowed: {url}")


def registry(spark: SparkSession, text: str, hosts: set[str] | None = None) -> DataFrame:
    """Rows as REGISTRY of a registry's JSON; one that lets schemas be fetched while documents are read is refused.

    Ids and paths are single, paths lead down only, hashes are SHA-256; addresses are checked where hosts are given.
    """
    try:
        told = json.loads(text)
        if told.get("network_resolution") is not False:
            raise Refused("the registry allows network resolution")
        rows = [(s["schema_id"], s["root"], s.get("namespace"), list(s["extensions"]), s["path"], s["sha256"].lower(), s.get("source_url")) for s in told["schemas"]]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        if isinstance(error, Refused):
            raise
        raise Refused("the registry has no such form") from error
    for schema_id, _, _, _, path, digest, url in rows:
        if not schema_id or path.startswith("/") or "\\" in path or ".." in path.split("/") or len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise Refused(f"{schema_id}: a path or a hash is wrong")
        if hosts is not None and url is not None:
            check_url(url, hosts)
    if len({r[0] for r in rows}) != len(rows):
        raise Refused("a schema is repeated")
    return spark.createDataFrame(rows, REGISTRY)


def verified(known: DataFrame, files: DataFrame) -> DataFrame:
    """(schema_id, path, state) of each schema of the registry: ok, missing, or changed; files (path, sha256) are those of the store, by path below it."""
    have = files.groupBy("path").agg(F.max("sha256").alias("found"), F.count("*").alias("n"))
    state = F.when(F.col("found").isNull(), "missing").when((F.col("n") == 1) & (F.col("found") == F.col("sha256")), "ok").otherwise("changed")
    return known.select("schema_id", "path", "sha256").join(have, "path", "left").select("schema_id", "path", state.alias("state"))


def trusted(known: DataFrame, files: DataFrame) -> DataFrame:
    """The registry without schemas whose file isn't there as it should be."""
    return known.join(verified(known, files).where("state = 'ok'").select("schema_id"), "schema_id", "left_semi").select(*known.columns)
