"""The whole way out and back: documents to pseudonymised documents and their mapping, and restoration."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findall import each, spliced
from ..operators import inventory as ours
from ..operators import persons
from ..operators.detect import COMPOSITE, Recogniser, checked, spans_of, without_false_cards
from ..operators.generate import Generator, is_secret
from ..operators.overlap import class_of, resolved
from ..operators.policy import decide
from ..operators.vault import Keys, Known, allocate, entities, view
from ..functions.crypto import hmac_hex, prefixed
from ..session import materialise, spread


def resolved_spans(docs: DataFrame, recognisers: tuple[Recogniser, ...] = COMPOSITE, dealt: bool = False) -> DataFrame:
    """doc_id, text, spans (disjoint, ascending) of each row. Rows are dealt to all tasks first, as files with few row groups would keep few
    of them busy, unless they are dealt already."""
    rows = (docs if dealt else spread(docs)).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("spans", spans_of("text", recognisers)).withColumn("spans", without_false_cards("spans")).withColumn("spans", checked("spans", "text"))
    return rows.withColumn("spans", resolved(F.col("spans"), "text"))


def numbered(found: DataFrame) -> DataFrame:
    """What resolved_spans() gives, written, with a number of each row."""
    return materialise(found.withColumn("_row", F.monotonically_increasing_id()), "spans")


def pseudonymise(docs: DataFrame, scope: str, keys: Keys, known: DataFrame | Known | None = None, policy: DataFrame | None = None, recognisers: tuple[Recogniser, ...] = COMPOSITE, inventory: DataFrame | None = None, searched: bool = False, bare_names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_spans, n_entities, safe_text), mapping with its new rows.

    Public spans and those that the policy reveals stay; secrets become one-way references and enter no
    mapping; all others get the surrogate of their entity. Rows meet their spans by a number of their own, so null and
    repeated doc_ids do no harm. A span that ought to go and has nothing to go to fails the query: no text leaves half done.
    inventory is a table of labels (label) of any size: tokens that hold one go too, where no other span lies.
    bare_names: persons whom some text confirms by a title or label are found where they are named without, in all texts.
    searched says that docs has the column spans of resolved_spans() already, and texts that are not null; with a column _row too it is a written
    table whose rows that numbers, see numbered().
    Only spans and texts that meet them are shuffled.
    """
    rows = docs if searched and "_row" in docs.columns else numbered(docs.select("doc_id", "text", "spans") if searched else resolved_spans(docs, recognisers))
    spans = each(rows, "spans", "_row").where(class_of(F.col("type")) != "public")
    labelled = None
    if inventory is not None:
        labelled = materialise(ours.marked(rows, inventory, spans="spans"), "labelled")
    if bare_names:
        taken = each(rows, "spans", "_row").select("_row", "type", "value", "start", "end")
        taken = taken if labelled is None else taken.unionByName(labelled.select(*taken.columns))
        people = persons.marked(rows, taken)
        if people is not None:
            labelled = materialise(people if labelled is None else labelled.unionByName(people), "labelled")
    if labelled is not None:
        spans = spans.unionByName(labelled)
    found = entities(spans)
    revealed = None
    if policy is not None:
        decided = materialise(decide(found.select(F.col("kind").alias("type"), "value").distinct(), policy, keys).select("type", "value", "decision"), "decided")
        found = found.join(decided.where("decision = 'anonymise'").select(F.col("type").alias("kind"), "value"), ["kind", "value"], "left_semi")
        revealed = decided.where("decision != 'anonymise'").select("type", "value", F.lit(True).alias("revealed"))
    found = materialise(found, "entities")
    new = allocate(found, scope, keys, known)
    generator = Generator(keys.salt(scope))
    # A real value has one surrogate under whatever type, so values meet mappings by real_idx, else by key_idx; what is known apart
    # from what is new, so that a known side in buckets is read where it lies.
    before, fresh = None if known is None else Known.of(known), Known.of(new)
    mapping = new if before is None else before.by_key.unionByName(new)
    values = found.select("kind", "value", hmac_hex(keys.index, prefixed(F.lit(scope), F.lower(F.col("canon")["normalized"]))).alias("real_idx"), hmac_hex(keys.index, prefixed(F.lit(scope), F.col("etype"), F.col("canon")["key"])).alias("key_idx"))
    sides = [fresh] if before is None else [before, fresh]
    for side, part in [(i, "real") for i in range(len(sides))] + [(i, "key") for i in range(len(sides))]:
        known_rows = sides[side].real(scope) if part == "real" else sides[side].keyed(scope)
        values = values.join(known_rows.withColumnRenamed("surrogate", f"_{part}{side}"), f"{part}_idx", "left")
    values = values.select(F.col("kind").alias("type"), "value", F.coalesce(*(f"_{part}{i}" for part in ("real", "key") for i in range(len(sides)))).alias("surrogate"))
    placed = spans.join(values, ["type", "value"], "left").withColumn("new", F.when(is_secret(F.col("type")), generator.secret(F.col("type"), F.col("value"))).otherwise(F.col("surrogate")))
    if revealed is not None:
        placed = placed.join(revealed, ["type", "value"], "left").where("new is not null or revealed is null")
    refuse = F.raise_error(F.concat(F.lit("a span has no surrogate; its type is "), F.col("type")))
    placed = placed.withColumn("new", F.when(F.col("new").isNull(), refuse).otherwise(F.col("new")))
    by_row = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new", "type"))).alias("placed"))
    n_spans = F.size("spans").cast("bigint")
    if labelled is not None:
        by_row = by_row.join(labelled.groupBy("_row").agg(F.count("*").alias("_more")), "_row", "full_outer")
        n_spans = n_spans + F.coalesce("_more", F.lit(0).cast("bigint"))
    out = rows.join(by_row, "_row", "left").withColumn("placed", F.coalesce("placed", F.expr("cast(array() as array<struct<start:int,end:int,new:string,type:string>>)")))
    safe = out.select("doc_id", n_spans.alias("n_spans"), F.size("placed").cast("bigint").alias("n_entities"), spliced("text", "placed", "new").alias("safe_text"))
    return safe, mapping


#: What texts are cut into to meet surrogates: runs of letters and digits, which no border of a match parts, and single other characters.
RUN = "[A-Za-z0-9]+"
#: Shapes of surrogates that are sent to all tasks.
SMALL = 100_000
TOKEN = re.compile(f"{RUN}|[^A-Za-z0-9]")


def restore(texts: DataFrame, mapping: DataFrame, scope: str, keys: Keys, text: str = "safe_text") -> DataFrame:
    """texts with a column restored: every surrogate of the scope replaced by its real value, longest first; unknown ones stay.

    One plan for views of any size, see restore_by_join(): real values are decrypted in tasks and reach neither the driver
    nor a plan.
    """
    return restore_by_join(texts, view(mapping, scope, keys), text)


def _places(text: str, shapes: Iterable[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of what has borders like a match's, for shapes (anchor, characters before it, length)."""
    by: dict[str, list[tuple[int, int]]] = {}
    for anchor, before, size in set(shapes):
        by.setdefault(anchor, []).append((before, size))
    edge = lambda i: not (0 <= i < len(text) and text[i].isascii() and text[i].isalnum())
    for m in TOKEN.finditer(text):
        for before, size in by.get(m.group(), ()):
            a = m.start() - before
            if a >= 0 and a + size <= len(text) and edge(a - 1) and edge(a + size):
                yield a, a + size


def _shape(surrogate: str) -> tuple[str, int, int]:
    """Its anchor, which is its first run of letters and digits or else its first character, the characters before it, its length."""
    m = re.search(RUN, surrogate)
    return (m.group(), m.start(), len(surrogate)) if m else (surrogate[0], 0, len(surrogate))


def _candidates(texts: pd.Series, anchors: pd.Series, before: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([list({t[a:b] for a, b in _places(t, zip(*shapes, strict=True))}) for t, *shapes in zip(texts, anchors, before, sizes, strict=True)])


def _put_back(texts: pd.Series, surrogates: pd.Series, reals: pd.Series) -> pd.Series:
    """Leftmost first, then longest, as the alternation does."""
    out = []
    for text, names, values in zip(texts, surrogates, reals, strict=True):
        if names is None or text is None:
            out.append(text)
            continue
        by, parts, at = dict(zip(names, values, strict=True)), [], 0
        for a, b in sorted(_places(text, map(_shape, by)), key=lambda p: (p[0], -p[1])):
            if a >= at and (real := by.get(text[a:b])) is not None:
                parts += [text[at:a], real]
                at = b
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def restore_by_join(texts: DataFrame, real: DataFrame, text: str = "safe_text") -> DataFrame:
    """Restoration for views of any size, of surrogates of any characters.

    Tokens of a text meet the anchors of surrogates; where one stands, the text is cut as the surrogates with that anchor
    are long, and the cuts with borders meet the view by equality. So a text meets no surrogate that it doesn't hold,
    however many share an anchor. Texts are written once, with numbers, and move twice: to their cuts and to what they hold. Anchors
    go to the texts if there are SMALL or fewer, else the tokens to them. Only texts that hold surrogates pass through Python.
    """
    real = real.where("surrogate != ''")
    run = F.regexp_extract("surrogate", RUN, 0)
    shapes = real.select(
        F.when(run == "", F.substring("surrogate", 1, 1)).otherwise(run).alias("anchor"),
        F.when(run == "", 0).otherwise(F.length(F.regexp_extract("surrogate", "^[^A-Za-z0-9]*", 0))).alias("before"),
        F.length("surrogate").alias("size"),
    ).distinct()
    shapes = materialise(shapes, "shapes")
    once = materialise(texts.withColumn("_number", F.monotonically_increasing_id()), "texts")
    # Not explode(), for which Spark would infer a filter that takes each text apart once more.
    tokens = once.select("_number", F.explode_outer(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN.pattern), F.lit(0)))).alias("anchor"))
    met = tokens.join(F.broadcast(shapes) if shapes.count() <= SMALL else shapes, "anchor").groupBy("_number").agg(F.collect_list(F.struct("anchor", "before", "size")).alias("s"))
    candidates = F.pandas_udf(_candidates, "array<string>")
    cut = once.select("_number", F.col(text).alias("_text")).join(met, "_number").select("_number", F.explode_outer(candidates("_text", "s.anchor", "s.before", "s.size")).alias("surrogate"))
    hits = cut.join(real, "surrogate").groupBy("_number").agg(F.collect_list(F.struct("surrogate", "real")).alias("_by"))
    put_back = F.pandas_udf(_put_back, "string")
    held = once.join(hits, "_number", "left")
    new = put_back(F.when(F.col("_by").isNotNull(), F.col(text)), "_by.surrogate", "_by.real")
    return held.withColumn("_new", new).withColumn("restored", F.when(F.col("_by").isNull(), F.col(text)).otherwise(F.col("_new"))).drop("_number", "_by", "_new")
