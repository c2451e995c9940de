"""Secret scan of whole texts with one combined automaton.

All rules are found in a single pass over the bytes (see ``automaton``).  The
automaton reports matches whose tail has at least a few bytes; the exact least
length of each rule is checked on the span found.  Offsets are code points, the
end exclusive; spans of one rule are leftmost and do not overlap.

Defined results: null and empty texts have no spans; rows with null or
repeated ids come back one for one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.automaton import Automaton, Rule, compile_rules
from nextbest.llm.common import id_and_text, slices, texts_of

_SLICE = 1 << 19

#: kind, what begins a match, the class that ends it, least length of the class part.  Letters of ``assign`` in either case.
RULES = (
    ("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8, True),
    ("access", "AKIA", "[A-Z0-9]", 12, False),
    ("hex", "", "[0-9a-f]", 32, False),
    ("github", "gh[pousr]_", "[A-Za-z0-9]", 36, False),
    ("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10, False),
)
BASE = ("assign", "access", "hex")
_REPORT = 8


def automaton() -> Automaton:
    return compile_rules(tuple(Rule(k, p, t, min(n, _REPORT), i) for k, p, t, n, i in RULES))


def exact_spans(machine: Automaton, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text in code points, ordered by start and then kind as listed."""
    out = []
    for text, spans in zip(texts, machine.spans(texts), strict=True):
        rows = []
        if spans:
            point = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
            for r, start, end in spans:
                kind, _, tail, least, _ = RULES[r]
                if _tail(text, start, end, r) >= least:
                    rows.append((int(point[start]), r, kind, int(point[end])))
        out.append([(kind, start, end) for start, _, kind, end in sorted(rows)])
    return out


def _tail(text: bytes, start: int, end: int, r: int) -> int:
    """Bytes of the match that belong to the rule's tail."""
    kind = RULES[r][0]
    if kind == "hex":
        return end - start
    if kind in ("access", "slack", "github"):
        return end - start - (5 if kind == "slack" else 4)
    # after the first : or = and what may follow it up to the value
    match = text[start:end]
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    value = match[at:].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def _scan(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                spans = exact_spans(machine.value, texts_of(batch.column("text")))
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the spans of every text as an array of (kind, start, end)."""
    machine = docs.sparkSession.sparkContext.broadcast(automaton())  # a fixed size: it depends on the rules alone
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(machine), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The columns of ``docs`` with every span in the text replaced by ``mark`` (spans that overlap by one mark)."""
    machine = docs.sparkSession.sparkContext.broadcast(automaton())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, _SLICE):
                texts = batch.column(text_col).to_pylist()
                for i, spans in enumerate(exact_spans(machine.value, [(t or "").encode() for t in texts])):
                    if spans:
                        out, at = [], 0
                        for _, start, end in spans:
                            if start >= at:
                                out += [texts[i][at:start], mark]
                            at = max(at, end)
                        texts[i] = "".join([*out, texts[i][at:]])
                place = batch.schema.get_field_index(text_col)
                yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans, sep: str = ","):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(sep, F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
