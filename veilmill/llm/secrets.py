"""Secret scans: base patterns, and formats that a probabilistic automaton has learned from labelled credentials.

The base patterns' values are the labelled credentials. A prefix tree of a bounded sample of them is generalised as in
ALERGIA: states whose next-symbol and ending frequencies are compatible (Hoeffding's bound, recursively) are merged into a
deterministic probabilistic automaton. Its symbols are character classes. Every candidate, a long run of credential
characters that no base span covers whole, is scored by its likelihood per character under the
automaton against that under the text's ordinary long words; likely ones are spans too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns of the base scan, in the order in which kinds are listed; ASCII letters only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Whole runs of at least HEX_CHARS, which is what stays of the runs [0-9a-f]+ when shorter ones are dropped.
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}")
KINDS = ("assign", "access", "hex", "learned")
#: What may be a credential of unknown format.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Credentials, and ordinary words, that the automaton and its rival learn from: those with the least hash.
FIT_ROWS = 20_000
#: Confidence of the compatibility test; least log-likelihood per character of a span, and its least excess over that of ordinary words.
ALPHA, LEAST, MARGIN = 0.05, -2.2, 0.25


def symbol(c: str) -> str:
    """The class of a character that the automaton reads."""
    if c in "0123456789":
        return "9"
    if c in "abcdef":
        return "f"
    if "a" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "F"
    if "A" <= c <= "Z":
        return "Z"
    return c


@dataclass
class State:
    passes: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> list[State]:
    states = [State()]
    for s in strings:
        at = 0
        states[0].passes += 1
        for c in map(symbol, s):
            node = states[at]
            if c not in node.next:
                node.next[c] = len(states)
                states.append(State())
            node.counts[c] = node.counts.get(c, 0) + 1
            at = node.next[c]
            states[at].passes += 1
        states[at].ends += 1
    return states


def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
    bound = (1 / math.sqrt(n1) + 1 / math.sqrt(n2)) * math.sqrt(0.5 * math.log(2 / ALPHA))
    return abs(f1 / n1 - f2 / n2) > bound


def _compatible(states: list[State], a: int, b: int) -> bool:
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        x, y = states[a], states[b]
        if not x.passes or not y.passes:
            continue
        if _differ(x.ends, x.passes, y.ends, y.passes):
            return False
        for c in x.next.keys() | y.next.keys():
            if _differ(x.counts.get(c, 0), x.passes, y.counts.get(c, 0), y.passes):
                return False
            if c in x.next and c in y.next:
                stack.append((x.next[c], y.next[c]))
    return True


def _merge(states: list[State], into: int, gone: int, parent: int, label: str) -> None:
    """Folds the tree below gone into the automaton at into."""
    states[parent].next[label] = into
    stack = [(into, gone)]
    while stack:
        a, b = stack.pop()
        x, y = states[a], states[b]
        x.passes += y.passes
        x.ends += y.ends
        for c, n in y.counts.items():
            x.counts[c] = x.counts.get(c, 0) + n
            if c in x.next:
                stack.append((x.next[c], y.next[c]))
            else:
                x.next[c] = y.next[c]


def infer(strings: list[str]) -> list[State]:
    """A deterministic probabilistic automaton for the strings; state 0 is the start."""
    states = prefix_tree(strings)
    red, fringe = [0], [(0, c) for c in sorted(states[0].next)]
    while fringe:
        parent, label = fringe.pop(0)
        blue = states[parent].next[label]
        if blue in red:
            continue
        for r in red:
            if _compatible(states, r, blue):
                _merge(states, r, blue, parent, label)
                fringe += [(r, c) for c in sorted(states[r].next) if states[r].next[c] not in red and (r, c) not in fringe]
                break
        else:
            red.append(blue)
            fringe += [(blue, c) for c in sorted(states[blue].next)]
    number = {r: i for i, r in enumerate(red)}
    return [State(states[r].passes, states[r].ends, {c: number[t] for c, t in states[r].next.items() if t in number}, states[r].counts) for r in red]


def likelihood(automaton: list[State], text: str, unseen: float = 1e-3) -> float:
    """Mean log-probability per character; a symbol that a state has not seen costs log(unseen) and leads to the start."""
    at, total = 0, 0.0
    for c in map(symbol, text):
        state = automaton[at]
        n = state.counts.get(c, 0)
        if n and c in state.next:
            total += math.log(n / state.passes)
            at = state.next[c]
        else:
            total += math.log(unseen)
            at = 0
    return total / max(1, len(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _value(text: str, kind: str, start: int, end: int) -> str:
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


SCANNED = "doc_id bigint, kinds array<string>, starts array<int>, ends array<int>, secrets array<string>, c_starts array<int>, candidates array<string>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch.text:
            spans = base_spans(text)
            found = []
            for m in CANDIDATE.finditer(text):
                if not any(a <= m.start() and m.end() <= b for _, a, b in spans):
                    found.append((m.start(), m.group()))
            out.append(([k for k, _, _ in spans], [a for _, a, _ in spans], [b for _, _, b in spans], [_value(text, *s) for s in spans], [a for a, _ in found], [s for _, s in found]))
        frame = pd.DataFrame(out, columns=["kinds", "starts", "ends", "secrets", "c_starts", "candidates"])
        frame.insert(0, "doc_id", batch.doc_id.astype("Int64").to_numpy(dtype=object, na_value=None) if len(batch) else [])
        yield frame.astype({"doc_id": "Int64"})


def fit(scanned: DataFrame) -> tuple[list[State], list[State]]:
    """Automata of credentials and of ordinary long words (candidates without digits), from at most FIT_ROWS of each, of all texts."""
    least = lambda df: [r[0] for r in df.where("s is not null").distinct().orderBy(F.xxhash64("s"), "s").limit(FIT_ROWS).collect()]
    secrets = least(scanned.select(F.explode("secrets").alias("s")))
    words = least(scanned.select(F.explode("candidates").alias("s")).where(~F.col("s").rlike("[0-9]")))
    return infer(secrets), infer(words)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned for each row of docs.

    Offsets count code points, ends exclusive. A null text is an empty one, without spans; rows that repeat are
    judged each. Without any base span nothing is learned and no span is added. Empty docs give an empty result.
    Further columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanned = written(rows.mapInPandas(_scan, SCANNED), "secrets-scanned")
    secret, ordinary = fit(scanned)
    known = len(secret) > 1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                base = list(zip(r.kinds, r.starts, r.ends, strict=True))
                more = [("learned", a, a + len(s)) for a, s in zip(r.c_starts, r.candidates, strict=True) if known and (fits := likelihood(secret, s)) >= LEAST and fits - likelihood(ordinary, s) >= MARGIN]
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                out.append((r.doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])
            yield frame.astype({"doc_id": "Int64"})

    return scanned.mapInPandas(score, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_learned bigint")
