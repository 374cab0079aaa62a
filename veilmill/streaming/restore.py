"""Restoration of streamed answers: surrogates that are cut across chunks are found, order within a micro-batch doesn't matter."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream_id string, block int, seq bigint, text string, error string"
STATE = "next bigint, kept string, waiting string, json string"
#: Most characters that a block may hold back.
MOST_HELD = 16 << 20


class Restorer:
    """Replaces the surrogates of a view, longest first; surrogates only match between other characters than letters and digits."""

    def __init__(self, view: dict[str, str]):
        self.view = view
        names = sorted(view, key=lambda s: (-len(s), s))
        self.pattern = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, names)) + ")(?![A-Za-z0-9])") if names else None
        self.keep = max(map(len, names), default=0) + 1

    def whole(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.view[m.group()], text) if self.pattern else text

    def feed(self, held: str, text: str) -> tuple[str, str]:
        """What can go out, and the tail that a surrogate may still begin or end in.

        The first held character has gone out already; it only serves to see what stands before the rest.
        """
        joined = held + text
        cut = max(0, len(joined) - self.keep)
        if self.pattern:
            for m in self.pattern.finditer(joined):
                if m.start() < cut < m.end() + 1:
                    cut = m.start()
                    break
        return joined[:cut], joined[cut:]


def restored_lines(text: str, whole) -> str:
    """A block that can't be read, restored line by line; a line that would become several stays as it is."""
    out = []
    for line in text.split("\n"):
        new = whole(line)
        out.append(line if "\n" in new or "\r" in new else new)
    return "\n".join(out)


def restored_stream(events: DataFrame, view: dict[str, str], most_held: int = MOST_HELD, silence: int | None = None) -> DataFrame:
    """stream_id, block, seq, text, error of events (stream_id, block, seq, kind, text).

    kind: 'text' chunks come out as soon as no surrogate can be cut; 'json' fragments come out once, whole, at the
    'stop' of their block, and raw with error 'invalid json' if they are none; 'raw' blocks come out restored line by
    line; 'stop' flushes and ends the block, whose state goes; 'opaque' passes through. A chunk without an earlier start
    begins its block. Chunks wait until those with smaller seq of their block (from 0) have come.

    Nothing is held without bound: a block that holds more than most_held characters gives out what it holds, in order of seq,
    with error 'too large', and ends; with silence, so does one without news for so many seconds, with error 'inactive'. Timers
    keep a query running batches, so a query that is to end when its input does goes without. A chunk of another
    kind comes out with error 'unknown kind'. What comes after a block's end begins a block of that number anew.
    The view is that of the query's start; restart the query to take a new one.
    """
    restorer = Restorer(view)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, kept, waiting, fragments = state.get if state.exists else (0, "", "[]", "")
        queue = {int(s): (k, t) for s, k, t in json.loads(waiting)}
        out: list[tuple] = []

        def emit(seq: int, text: str, error: str | None = None) -> None:
            if text or error:
                out.append((key[0], key[1], seq, text, error))

        def close(reason: str) -> None:
            rest = restorer.whole(kept) + fragments + "".join(t if k in ("json", "opaque") else restorer.whole(t) for _, (k, t) in sorted(queue.items()))
            emit(max([nxt, *queue]), rest, reason)
            state.remove()

        if state.hasTimedOut:
            close("inactive")
            yield pd.DataFrame(out, columns=["stream_id", "block", "seq", "text", "error"])
            return
        for batch in batches:
            for r in batch.itertuples(index=False):
                if int(r.seq) >= nxt:
                    queue[int(r.seq)] = (r.kind, r.text or "")
        ended = False
        while nxt in queue and not ended:
            kind, text = queue.pop(nxt)
            if kind == "text":
                text, kept = restorer.feed(kept, text)
                emit(nxt, restorer.whole(text))
            elif kind == "json":
                fragments += text
            elif kind == "stop":
                text, error, ended = restorer.whole(kept), None, True
                kept = ""
                if fragments:
                    try:
                        text += json.dumps(_strings(json.loads(fragments), restorer.whole), ensure_ascii=False, separators=(",", ":"))
                    except ValueError:
                        text, error = text + fragments, "invalid json"
                    fragments = ""
                emit(nxt, text, error)
            elif kind == "raw":
                emit(nxt, restored_lines(text, restorer.whole))
            else:
                emit(nxt, text, None if kind == "opaque" else "unknown kind")
            nxt += 1
        if len(kept) + len(fragments) + sum(len(t) for _, t in queue.values()) > most_held:
            close("too large")
        elif ended and not queue:
            state.remove()
        else:
            state.update((0 if ended else nxt, kept, json.dumps([[s, k, t] for s, (k, t) in queue.items()]), fragments))
            if silence is not None:
                state.setTimeoutDuration(silence * 1000)
        yield pd.DataFrame(out, columns=["stream_id", "block", "seq", "text", "error"])

    return events.groupBy("stream_id", "block").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if silence is None else GroupStateTimeout.ProcessingTimeTimeout)


def _strings(node, change):
    if isinstance(node, str):
        return change(node)
    if isinstance(node, list):
        return [_strings(x, change) for x in node]
    if isinstance(node, dict):
        return {k: _strings(v, change) for k, v in node.items()}
    return node
