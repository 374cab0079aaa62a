"""Find-all with offsets and replacement by lookup, in built-in expressions. Offsets count code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<type:string,value:string,start:int,end:int,score:double>"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Marks around matches: two code points that Unicode sets aside for internal use. Texts that have them are searched without.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
#: Matches that are folded at once.
CHUNK = 16


def find_all(text: str, pattern: str, kind: str, score: float, needs: tuple[str, ...] = (), guard: str = "") -> Column:
    """array<SPAN> of the matches of a Java pattern in the column named text. The pattern must not match the empty string.

    One pass of the pattern puts marks around its matches; what stands between marks gives values and offsets.
    needs: substrings one of which every match has; a text without them is not searched. guard: a pattern that is quick to fail and found in
    each text that has a match, the pattern itself by default; a text without it is not taken apart.
    """
    cheap = f"({' or '.join(f'contains({text}, {_text(n)})' for n in needs) or 'true'}) and rlike({text}, {_text(guard or pattern)})"
    held = f"(contains({text}, '{OPEN}') or contains({text}, '{CLOSE}'))"
    marked = f"regexp_replace(if({held}, translate({text}, '{OPEN}{CLOSE}', '\ufffd\ufffd'), {text}), {_text(pattern)}, '{OPEN}$0{CLOSE}')"
    # transform(array(x), p -> ...)[0] binds x, which would be computed wherever it stands. A piece is a match, its mark, and the gap after.
    # Pieces are folded in chunks, each from where it begins, so that no fold copies a list that grows with the text.
    found = F.expr(f"""
        transform(array(split({marked}, '{OPEN}')), pieces -> transform(
            array(transform(sequence(0, greatest(size(pieces) - 2, 0) div {CHUNK}), c -> slice(pieces, 2 + c * {CHUNK}, {CHUNK}))), chunks -> transform(
            array(aggregate(chunks, array(length(pieces[0])), (s, ch) -> concat(s, array(element_at(s, -1) + aggregate(ch, 0, (n, x) -> n + length(x) - 1))))), base ->
            flatten(transform(chunks, (ch, c) -> aggregate(
                ch,
                named_struct('at', base[c], 'out', cast(array() as array<{SPAN}>)),
                (s, x) -> named_struct('at', s.at + length(x) - 1, 'out', concat(s.out, array(
                    named_struct('type', {_text(kind)}, 'value', substring_index(x, '{CLOSE}', 1), 'start', s.at, 'end', s.at + length(substring_index(x, '{CLOSE}', 1)), 'score', {score}D)))),
                s -> s.out))))[0])[0])[0]
    """)
    exact = F.when(F.expr(held), F.transform(found, lambda x: x.withField("value", F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"])))).otherwise(found)
    return F.when(F.expr(cheap), F.coalesce(exact, F.expr(f"cast(array() as array<{SPAN}>)"))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def each(rows: DataFrame, spans: str, *keep: str) -> DataFrame:
    """keep and the fields of each of the spans, in rows of their own.

    Not by explode(), for which Spark would infer a filter that computes spans once more, several times over, to see that there are any.
    """
    return rows.select(*keep, F.explode_outer(spans).alias("s")).where("s is not null").select(*keep, "s.*")


def spliced(text: str, spans: str, replacement: str) -> Column:
    """text with each of the disjoint spans, ascending, replaced by its field named replacement."""
    return F.expr(f"""
        aggregate({spans}, named_struct('at', 0, 'out', ''),
            (s, x) -> named_struct('at', x.end, 'out', concat(s.out, substr({text}, s.at + 1, x.start - s.at), x.{replacement})),
            s -> concat(s.out, substr({text}, s.at + 1)))
    """)


def replaced(text: Column, pattern: str, by: Column) -> Column:
    """text with every match of the pattern replaced by its value in the map by; matches without one stay."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    new = F.transform(found, lambda x: F.coalesce(F.element_at(by, x), x))
    return F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
