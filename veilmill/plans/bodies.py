"""JSON bodies on the way out and back: their leaves as rows, detection and restoration on these, and the bodies put together again."""

from __future__ import annotations

import json
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import walk
from ..operators.detect import RECOGNISERS, Recogniser
from ..operators.vault import Keys
from ..session import materialise
from . import pseudonymise as plan


def _is_json(bodies: pd.Series) -> pd.Series:
    def fine(b):
        try:
            json.loads(b)
        except (TypeError, ValueError):
            return False
        return True

    return bodies.map(fine)


def _rows(bodies: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """bodies with a number of their own and whether they are JSON, and their leaves (_row, path, text)."""
    rows = materialise(bodies.withColumn("_row", F.monotonically_increasing_id()).withColumn("_json", F.pandas_udf(_is_json, "boolean")(F.col(body))), "bodies")
    leaves = walk.exploded(rows.where("_json").select("_row", F.col(body).alias("_b")), "_row", "_b")
    texts = rows.where(~F.col("_json") & F.col(body).isNotNull()).select("_row", F.lit(None).cast("string").alias("path"), F.col(body).alias("text"))
    return rows, leaves.unionByName(texts)


def _together(rows: DataFrame, changed: DataFrame, body: str) -> DataFrame:
    """The bodies with their changed leaves (_row, path, text); a body that is no JSON is one leaf without a path."""
    plain = changed.where("path is null").select("_row", F.col("text").alias("_text"))
    out = walk.put_back(rows, changed.where("path is not null").select("_row", "path", "text"), "_row", body).join(plain, "_row", "left")
    return out.withColumn(body, F.coalesce("_text", body)).drop("_text")


def pseudonymised(bodies: DataFrame, scope: str, keys: Keys, body: str = "body", known: DataFrame | None = None, recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> tuple[DataFrame, DataFrame]:
    """bodies (all columns) with everything that is found in their leaves replaced, and the mapping.

    A body that is no JSON goes through as one text. Keys of free maps are leaves as well; two keys that would become
    one fail the query.
    """
    rows, leaves = _rows(bodies, body)
    leaves = materialise(leaves.withColumn("doc_id", F.monotonically_increasing_id()), "leaves")
    safe, mapping = plan.pseudonymise(leaves.select("doc_id", "text"), scope, keys, known, recognisers=recognisers)
    changed = leaves.select("doc_id", "_row", "path").join(safe.where("n_entities > 0").select("doc_id", F.col("safe_text").alias("text")), "doc_id")
    return _together(rows, changed.drop("doc_id"), body).drop("_row", "_json"), mapping


def restored(bodies: DataFrame, mapping: DataFrame, scope: str, keys: Keys, body: str = "body", strict: bool = False) -> DataFrame:
    """bodies (all columns) with real values in place of surrogates, and unresolved: 1 for a body that ought to be JSON and is none.

    A body that is no JSON is restored as a text, or fails the query if strict. An error body is a body like any other.
    """
    rows, leaves = _rows(bodies, body)
    back = plan.restore(leaves, mapping, scope, keys, "text")
    out = _together(rows, back.where("not (restored <=> text)").select("_row", "path", F.col("restored").alias("text")), body)
    broken = (~F.col("_json") & F.col(body).isNotNull()).cast("bigint")
    if strict:
        broken = F.when(broken == 1, F.raise_error(F.lit("a body is no JSON"))).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("unresolved", broken).drop("_row", "_json")


def unresolved(bodies: DataFrame) -> DataFrame:
    """n, unresolved: the counters over restored bodies."""
    return bodies.agg(F.count("*").alias("n"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))


def announced(bodies: DataFrame, notice: str, body: str = "body") -> DataFrame:
    """Requests with a notice in front of their system prompt, be that absent, a text or a list of blocks; other bodies as they are."""

    def one(text):
        try:
            node = json.loads(text)
        except (TypeError, ValueError):
            return text
        if not isinstance(node, dict) or "messages" not in node:
            return text
        before = node.get("system")
        if before is None or isinstance(before, str):
            node["system"] = notice if not before else f"{notice}\n\n{before}"
        elif isinstance(before, list):
            node["system"] = [{"type": "text", "text": notice}, *before]
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"))

    return bodies.withColumn(body, F.pandas_udf(lambda b: b.map(one).astype(object), "string", F.PandasUDFType.SCALAR)(F.col(body)))


def _searchable(text: str | None) -> str | None:
    if text is None:
        return None
    plain = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text).replace("\\/", "/")
    if "%" in plain:
        plain += "\n" + unquote(plain, errors="replace")
    return unicodedata.normalize("NFKC", plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def searchable(text: Column) -> Column:
    r"""A captured body as leaks are searched in it: \uXXXX and \/ undone, what percent signs stand for added, in Unicode's NFKC."""
    odd = text.rlike(r"\\u|\\/|%|[^\p{ASCII}]")
    return F.when(odd, F.pandas_udf(lambda b: b.map(_searchable).astype(object), "string", F.PandasUDFType.SCALAR)(F.when(odd, text))).otherwise(text)
