"""Detection: texts to spans. Recognisers are Java and RE2 patterns at once, so SQL engines can check them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.findall import SPAN, each, find_all
from . import written_dates


@dataclass(frozen=True)
class Recogniser:
    r"""A pattern that must not match the empty string, with the type and score of its spans.

    needs: substrings one of which every match has, if there are any; cheap to look for before the pattern. guard: a pattern that
    starts with a rare character, without \b or a look behind, and is found in every match or about it; Java fails it several times faster.
    gate: one of GATES that every text with a match passes.
    """

    name: str
    kind: str
    pattern: str
    score: float = 0.85
    needs: tuple[str, ...] = ()
    guard: str = field(default="", repr=False)
    gate: str = field(default="", repr=False)


#: What texts are looked through for once, before recognisers that need it.
GATES = {
    "digit": lambda text: reduce(or_, (F.contains(text, F.lit(x)) for x in "0123456789")),
    "mark": lambda text: reduce(or_, (F.contains(text, F.lit(x)) for x in "-_:=@")),
    "hex": lambda text: text.rlike("[0-9a-f]{40}"),
}

# Repetitions are bounded, by what the formats allow at most, so that no text takes time in proportion to its square.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RECOGNISERS = (
    Recogniser("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]{1,254}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,10}\.[A-Za-z]{2,63}", 0.9, ("@",), gate="mark"),
    Recogniser("ipv4", "IP_ADDRESS", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", 0.9, guard=r"[0-9]\.[0-9]{1,3}\.[0-9]", gate="digit"),
    Recogniser("card", "CREDIT_CARD", r"\b[0-9]{16}\b", 0.7, guard=r"[0-9]{16}", gate="digit"),
    Recogniser("assignment", "PASSWORD_CONTEXT", r"(?i)\b(?:password|passwd|secret|token|api_?key)\b\s*[:=]\s*[\"'][^\"'\s]+[\"']", 0.95, guard=r"[:=]\s*[\"'][^\"'\s]", gate="mark"),
    Recogniser("phone", "PHONE_NUMBER", r"\+[0-9]{1,3} ?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,4}){2,4}", 0.8, ("+",), guard=r"\+[0-9]", gate="digit"),
    Recogniser("url", "URL", r"https?://[^\s\"'<>()]+", 0.85, ("http://", "https://"), gate="mark"),
    Recogniser("jwt", "JWT", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0.95, ("eyJ",)),
    Recogniser("uuid", "UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 0.9, ("-",), guard=r"[0-9a-fA-F]-[0-9a-fA-F]{4}-", gate="mark"),
    Recogniser("mac", "MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", 0.9, (":",), guard=r":[0-9A-Fa-f]{2}:", gate="mark"),
    Recogniser("sha1", "COMMIT_SHA", r"\b[0-9a-f]{40}\b", 0.85, guard=r"[0-9a-f]{40}", gate="hex"),
    Recogniser("sha256", "HASH", r"\b[0-9a-f]{64}\b", 0.85, guard=r"[0-9a-f]{40}", gate="hex"),
    Recogniser("cve", "CVE_ID", r"\bCVE-[0-9]{4}-[0-9]{4,7}\b", 0.95, ("CVE-",), gate="digit"),
    Recogniser("host", "HOSTNAME", r"\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,10}\.(?:internal|local|lan|intra|corp|example|test|com|net|org|io)\b", 0.8, guard=r"\.(?:internal|local|lan|intra|corp|example|test|com|net|org|io)\b"),
    Recogniser("service", "SERVICE_ACCOUNT", r"\bsvc-[a-z0-9-]{1,100}-(?:prod|staging|dev)\b", 0.9, ("svc-",), gate="mark"),
    Recogniser("date", "DATE", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0.8, ("-",), guard=r"[0-9]-[0-9]{2}-[0-9]", gate="digit"),
    *(Recogniser(f"token{i}", kind, pattern, score, needs, *(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "digit") if kind == "IBAN_CODE" else ("", "" if "AKIA" in needs else "mark")) for i, (kind, pattern, score, needs) in enumerate(fixed.TOKEN_FORMATS)),
)
BY_NAME = {r.name: r for r in RECOGNISERS}
#: The lines that open and close armour.
ARMOUR = r"-----(?:BEGIN|END) [A-Z0-9 ]+-----"


def armour_spans(text: str) -> Column:
    """Blocks of any length from an opening line to the closing one of the same name that is the next such line."""
    marks = find_all(text, ARMOUR, "CRYPTOGRAPHIC_KEY", 0.99, needs=("-----BEGIN ",))

    def paired(m: Column) -> Column:
        def block(a: Column, i: Column) -> Column:
            b = F.get(m, i + 1)
            fits = b["value"] == F.concat(F.lit("-----END "), F.substring(a["value"], F.lit(12), F.length(a["value"])))
            kind = F.when(F.contains(a["value"], F.lit("CERTIFICATE")), "CERTIFICATE").otherwise("CRYPTOGRAPHIC_KEY")
            return F.when(F.startswith(a["value"], F.lit("-----BEGIN ")) & fits, F.struct(kind.alias("type"), F.substring(F.col(text), a["start"] + 1, b["end"] - a["start"]).alias("value"), a["start"].alias("start"), b["end"].alias("end"), a["score"].alias("score")))

        return F.filter(F.transform(m, block), lambda s: s.isNotNull())

    return F.get(F.transform(F.array(marks), paired), F.lit(0))


def spans_of(text: str, recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> Column:
    """All spans of the column named text, by start and then by length, longest first; none where no word character is."""
    none = F.array().cast(f"array<{SPAN}>")

    def behind(gates: Column) -> Column:
        gated = lambda gate, found: F.when(gates[gate], found).otherwise(none) if gate else found
        return F.flatten(F.array(gated("mark", armour_spans(text)), *(gated(r.gate, find_all(text, r.pattern, r.kind, r.score, needs=r.needs, guard=r.guard)) for r in recognisers)))

    # transform(array(x), f)[0] computes x once.
    gates = F.struct(*(gate(F.col(text)).alias(name) for name, gate in GATES.items()))
    found = F.get(F.transform(F.array(gates), behind), F.lit(0))
    found = F.array_sort(F.array_distinct(found), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.when(F.col(text).rlike(r"(?U)\w"), found).otherwise(none)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> DataFrame:
    """key, text, spans: one row per row; nothing is shuffled and Python takes no part."""
    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("spans", spans_of(text, recognisers))


def exploded(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    return each(detected, "spans", key)


def values(df: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, value of each match of one recogniser."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(BY_NAME[name].pattern), F.lit(0))).alias("value"))


def trimmed(spans: str, border: str = r"[\s.,;:!?'\"()\[\]{}<>]") -> Column:
    """Spans without punctuation at their borders, anchored anew; what is empty then is dropped."""
    return F.expr(f"""
        filter(transform({spans}, span_ -> named_struct(
            'type', span_.type, 'value', regexp_replace(span_.value, '^{_q(border)}+|{_q(border)}+$', ''),
            'start', span_.start + length(regexp_extract(span_.value, '^{_q(border)}*', 0)),
            'end', span_.start + length(regexp_extract(span_.value, '^{_q(border)}*', 0)) + length(regexp_replace(span_.value, '^{_q(border)}+|{_q(border)}+$', '')),
            'score', span_.score)), span_ -> span_.end > span_.start)
    """)


def _q(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def merged_spans(spans: Column, text: Column) -> Column:
    """Neighbouring spans of one type as one, where at most two linking characters (hyphen, apostrophe, blank) part them.

    Each span meets the end of the run before it, so nested and overlapping spans of a type merge too; the score is the least.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))))
    run = "struct<type:string,start:int,end:int,score:double>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("out"), F.lit(None).cast(run).alias("run"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["run"]["end"] + 1, x["start"] - s["run"]["end"])
        near = (x["start"] <= s["run"]["end"]) | ((x["start"] - s["run"]["end"] <= 2) & gap.rlike("\\A[-'’ \u00a0]*\\z"))
        joins = F.coalesce((s["run"]["type"] == x["type"]) & near, F.lit(False))
        grown = F.struct(x["type"].alias("type"), s["run"]["start"].alias("start"), F.greatest(s["run"]["end"], x["end"]).alias("end"), F.least(s["run"]["score"], x["score"]).alias("score"))
        done = F.when(joins | s["run"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["run"])))
        return F.struct(done.alias("out"), F.when(joins, grown).otherwise(x).alias("run"))

    runs = F.aggregate(ordered, start, step, lambda s: F.when(s["run"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["run"]))))
    return F.transform(runs, lambda r: F.struct(r["type"].alias("type"), F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("value"), r["start"].alias("start"), r["end"].alias("end"), r["score"].alias("score")))


def merged_fragments(spans: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """merged_spans() of spans in rows of their own. Each text meets its spans once, as one array."""
    gathered = spans.groupBy(key).agg(F.collect_list(F.struct("type", "value", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"))).alias("spans"))
    rows = texts.select(key, "text").join(gathered, key)
    return rows.select(key, F.explode(merged_spans(F.col("spans"), F.col("text"))).alias("s")).select(key, "s.*")


#: Scores from which an entity counts, after its pieces were merged; labels of models by the types that they become, others are dropped.
LEAST_SCORE, LABELS = 0.5, {"person": "PERSON", "date": "DATE", "address": "ADDRESS"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", '"': '"', "'": "'", "«": "»", "“": "”"}


def projected(spans: Column) -> Column:
    """Spans of a model's labels as spans of types; labels that are not in LABELS are dropped."""
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.filter(F.transform(spans, lambda s: s.withField("type", F.element_at(table, F.lower(s["type"])))), lambda s: s["type"].isNotNull())


def scored(spans: Column, least: float = LEAST_SCORE) -> Column:
    return F.filter(spans, lambda s: s["score"] >= least)


def shaped(spans: Column) -> Column:
    """Spans that look like what they say: an address has a letter and a way, a comma or two words, a person a letter and two
    words or a capital first, a date a digit. Other types pass."""
    ways = "|".join((*fixed.WAYS_BEFORE, *fixed.WAYS_AFTER, *fixed.WAYS_JOINED))

    def fits(s: Column) -> Column:
        v, letter, several = F.trim(s["value"]), s["value"].rlike(r"\p{L}"), F.trim(s["value"]).rlike(r"\S\s+\S")
        address = letter & (several | F.contains(v, F.lit(",")) | v.rlike(rf"(?i)(?:{ways})"))
        return F.when(s["type"].isin("ADDRESS", "STREET_ADDRESS"), address).when(s["type"] == "PERSON", letter & (several | v.rlike(r"\A\p{Lu}"))).when(s["type"] == "DATE", v.rlike("[0-9]")).otherwise(True)

    return F.filter(spans, fits)


def cut_at_scaffolding(spans: Column) -> Column:
    """Spans cut where the output of a tool runs through them: a line end, blanks, a number and a tab."""
    pieces = lambda s: F.split(s["value"], r"\n[ \t]*[0-9]+\t", -1)
    marks = lambda s: F.regexp_extract_all(s["value"], F.lit(r"\n[ \t]*[0-9]+\t"), F.lit(0))

    def cut(s: Column) -> Column:
        lengths = lambda i: F.aggregate(F.slice(pieces(s), 1, i), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(marks(s), 1, i), F.lit(0), lambda n, x: n + F.length(x))
        parts = F.transform(pieces(s), lambda x, i: F.struct(s["type"].alias("type"), x.alias("value"), (s["start"] + lengths(i)).alias("start"), (s["start"] + lengths(i) + F.length(x)).alias("end"), s["score"].alias("score")))
        return F.when(s["value"].rlike(r"\n[ \t]*[0-9]+\t"), F.filter(parts, lambda p: F.trim(p["value"]) != "")).otherwise(F.array(s))

    return F.flatten(F.transform(spans, cut))


def reason_public(spans: DataFrame, texts: DataFrame, inventory, allow, key: str = "doc_id") -> DataFrame:
    """spans with reason: null for those to keep, else why they are public. What the inventory owns, in the token around the span or the
    span itself, is kept; else the token may be public as a whole, or the span as one of the token's parts between slashes."""
    rows = spans.join(texts.select(key, "text"), key).withColumn("token", token_around("text", "start", "end"))
    part = F.exists(F.split("token", "/"), lambda p: p == F.col("value"))
    own = inventory.owns(F.col("token")) | inventory.owns(F.col("value"))
    whole, single = allow.reason(F.col("type"), F.col("token")), allow.reason(F.col("type"), F.col("value"))
    return rows.withColumn("reason", F.when(own, F.lit(None).cast("string")).otherwise(F.coalesce(whole, F.when(part, single)))).drop("token", "text")


# Persons and addresses by rule, where no model is at hand.
_TITLE = r"(?:M\.|Mr\.?|Mrs\.?|Ms\.?|Mme\.?|Mlle\.?|Dr\.?|Prof\.?|Herr|Frau|Señora?|Sr\.|Sra\.)"
#: Where a title may end, by its first letter.
_TITLED = r"[MDPHFS](?:\.|r\.?|rs\.?|s\.?|me\.?|lle\.?|rof\.?|err|rau|eñora?|ra\.) \p{Lu}"
_NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_WAY_BEFORE, _WAY_AFTER, _WAY_JOINED = ("|".join(w) for w in (fixed.WAYS_BEFORE, fixed.WAYS_AFTER, fixed.WAYS_JOINED))
PERSONAL = (
    Recogniser("titled person", "PERSON", rf"(?<=(?<![\p{{L}}\p{{N}}]){_TITLE} ){_NAME_WORD}(?: (?:de |van |von |la |le |du )?{_NAME_WORD}){{0,3}}", 0.8, guard=_TITLED),
    Recogniser("named person", "PERSON", rf"(?<=\b(?:name|nom|contact|author|auteur|from|by|owner): ){_NAME_WORD}(?: (?:de |van |von |la |le |du )?{_NAME_WORD}){{1,3}}", 0.7, (": ",), guard=r"[emtry]: \p{Lu}", gate="mark"),
    Recogniser("address, way first", "ADDRESS", rf"\b[0-9]{{1,4}}(?: ?(?:bis|ter))?,? (?i:{_WAY_BEFORE}) (?:(?:de la|de|du|des|la|le|l'|d') ?)?\p{{L}}[\p{{L}}'’-]{{1,30}}(?: \p{{L}}[\p{{L}}'’-]{{1,30}}){{0,3}}(?:,? [0-9]{{4,5}} {_NAME_WORD}(?:[ -]{_NAME_WORD}){{0,2}})?", 0.75, guard=rf"[0-9](?: ?(?:bis|ter))?,? (?i:{_WAY_BEFORE}) ", gate="digit"),
    Recogniser("address, way last", "ADDRESS", rf"\b[0-9]{{1,5}} (?:{_NAME_WORD} ){{1,3}}(?i:{_WAY_AFTER})\b(?:, {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}(?:,? [A-Z]{{2}} [0-9]{{5}})?)?", 0.75, guard=r"[0-9] \p{Lu}[\p{L}'’-]{1,30} ", gate="digit"),
    Recogniser("address, joined", "ADDRESS", rf"\b\p{{Lu}}[\p{{L}}-]{{1,30}}(?i:{_WAY_JOINED}) [0-9]{{1,4}}[a-z]?(?:, [0-9]{{5}} {_NAME_WORD})?", 0.75, guard=r"[eEgGzZ] [0-9]", gate="digit"),
)
#: Dates as people write them.
WRITTEN_DATES = (Recogniser("written date", "DATE", written_dates.WRITTEN, 0.8, guard=written_dates.GUARD, gate="digit"), Recogniser("numeric date", "DATE", written_dates.NUMERIC, 0.75, guard=r"[0-9][/.][0-9]{1,2}[/.][0-9]", gate="digit"))
#: What leaves no text in clear by default: patterns, written dates, persons and addresses.
COMPOSITE = (*RECOGNISERS, *WRITTEN_DATES, *PERSONAL)
#: Recognisers by strategy: patterns only, persons and addresses too, or all of them.
STRATEGIES = {"regex": RECOGNISERS, "filtered": (*RECOGNISERS, *PERSONAL), "composite": COMPOSITE}


def strategy(name: str, types: tuple[str, ...] | None = None) -> tuple[Recogniser, ...]:
    """The recognisers of a strategy, of certain types only where such are given. An unknown one is an error."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    return tuple(r for r in STRATEGIES[name] if types is None or r.kind in types)


def with_model(df: DataFrame, model, text: str = "text") -> DataFrame:
    """df with spans of a model added to its column spans: model takes a pandas series of texts and gives, for each, a list of
    (label, start, end, score). Labels are projected, pieces merged, then low scores and misshapen spans dropped.
    A frame of many equal texts is searched once for each, see distinct_texts()."""

    @F.pandas_udf(f"array<{SPAN}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"type": k, "value": t[a:b], "start": a, "end": b, "score": float(p)} for k, a, b, p in spans] for t, spans in zip(batch, model(batch), strict=True)], dtype=object)

    ours = shaped(scored(merged_spans(projected(found(F.coalesce(F.col(text), F.lit("")))), F.col(text))))
    return df.withColumn("spans", F.concat("spans", ours) if "spans" in df.columns else ours)


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text once: equal texts have equal spans, so they need not be searched again."""
    return df.select(text).where(F.col(text).isNotNull()).distinct()


def without_false_cards(spans: str) -> Column:
    """A card number that fails its check digit goes if a longer span contains it; alone it stays."""
    return F.expr(f"""
        filter({spans}, span_ -> not (span_.type = 'CREDIT_CARD' and not luhn_check(regexp_replace(span_.value, '[^0-9]', ''))
            and exists({spans}, other_ -> other_.start <= span_.start and other_.end >= span_.end and other_.end - other_.start > span_.end - span_.start)))
    """)


def checked(spans: str, text: str) -> Column:
    """spans, or an error if one of them lies outside the text, is empty, or has no type or score."""
    bad = F.expr(f"exists({spans}, span_ -> span_.type is null or span_.start is null or span_.end is null or span_.score is null or isnan(span_.score) or span_.start < 0 or span_.end <= span_.start or span_.end > length({text}))")
    return F.when(bad, F.raise_error(F.lit("malformed span")).cast(f"array<{SPAN}>")).otherwise(F.col(spans))


def token_around(text: str, start: str, end: str) -> Column:
    """The run of characters without blanks around [start, end), without its border punctuation.

    Blanks are those of RE2, and ends are those of the text: $ would also stand before a line end that closes it.
    """
    before, after = F.expr(f"substr({text}, 1, {start})"), F.expr(f"substr({text}, {end} + 1)")
    whole = F.concat(F.regexp_extract(before, r"(?<![^ \t\n\f\r])[^ \t\n\f\r]*+\z", 0), F.expr(f"substr({text}, {start} + 1, {end} - {start})"), F.regexp_extract(after, r"\A[^ \t\n\f\r]*", 0))
    return F.regexp_replace(whole, r"\A[(\[{<\"'`,;:]+|[)\]}>\"'`,;:.!?]+\z", "")


def public_by_shape(spans: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """value, types, rule of the values that a rule (name, pattern) of public shapes matches whole; the first rule counts."""
    rule = F.coalesce(*(F.when(F.col("value").rlike(rf"\A(?:{p})\z"), F.lit(n)) for n, p in rules))
    return spans.withColumn("rule", rule).where("rule is not null").groupBy("value").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.first("rule").alias("rule"))
