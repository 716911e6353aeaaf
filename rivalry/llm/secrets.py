"""Secret scan: three fixed patterns, and a token-efficiency test for random strings.

A vocabulary packs words and identifiers into few tokens, but a random string needs about
one token for one or two characters. Long runs of token-like characters whose characters
per token are low are reported, after digests (by length or from a given list), UUIDs and
identifiers were excluded. What a fixed pattern leaves of a run is tested on its own, and a run
that is not random as a whole is tested part by part between its signs, as a name in front of
a key dilutes the ratio. All positions are code points, ends exclusive.

Defined cases: a null text is empty; empty texts and tables have no spans; null or repeated
ids are separate rows; texts of any length are walked once per pattern; of spans that begin
together the kind listed first comes first; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.memory import release
from rivalry.llm.tokens import texts, vocabulary

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of under 20 letters, numbers and camel-case parts joined by signs: names rather than keys.
IDENTIFIER = re.compile(r"[_=/+-]*(?:[A-Z]?[a-z]{2,19}|[A-Z]{2,19}|[0-9]{1,4})(?:[_=/+-]+(?:[A-Z]?[a-z]{2,19}|[A-Z]{2,19}|[0-9]{1,4})|[A-Z][a-z]{2,19})*[_=/+-]*")
#: Characters per token below which a run counts as random.
RATIO = 2.0
#: The same for letters of both cases and of one case alone, where words of languages that the vocabulary spells out lie (PRZEDSIEBIORSTWO... has 1.67).
CLEAR, SINGLE = 1.75, 1.6
#: The least length of a part.
LEAST = 20
#: Signs at which a run is cut, outermost first.
SIGNS = "=/_-"

_ENCODINGS: dict[str, object] = {}


def encoding(name_or_path: str):
    """One tiktoken encoding per worker process."""
    if name_or_path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary(name_or_path), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[name_or_path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name_or_path]


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _excluded(run: str, known: frozenset[str]) -> bool:
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run) or IDENTIFIER.fullmatch(run)) or run.lower() in known


def _random(run: str, enc, ratio: float) -> bool:
    """The ratio alone decides; a run without letters is a number."""
    small, large = any(c.islower() for c in run), any(c.isupper() for c in run)
    limit = ratio if any(c.isdigit() for c in run) else min(ratio, CLEAR if small and large else SINGLE)
    return (small or large) and len(run) < limit * len(enc.encode_ordinary(run))


def _parts(run: str, at: int, enc, ratio: float, known: frozenset[str]):
    """Spans of a run, or of its parts if it is not random as a whole."""
    if len(run) < LEAST or _excluded(run, known):
        return
    if _random(run, enc, ratio):
        yield at, 3, at + len(run)
        return
    sign = next((c for c in SIGNS if c in run), None)
    for part in run.split(sign) if sign else ():
        yield from _parts(part, at, enc, ratio, known)
        at += len(part) + 1


def random_spans(text: str, base: list[tuple[int, int, int]], enc, ratio: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """Runs and parts of runs that need many tokens for their length, outside the fixed patterns."""
    found, spans, i, live = [], sorted((s, e) for s, _, e in base), 0, []
    for m in RUN.finditer(text):
        at, end = m.start(), m.end()
        while i < len(spans) and spans[i][0] < end:
            live.append(spans[i])
            i += 1
        live = [s for s in live if s[1] > at]  # of each kind at most one reaches into a later run
        cuts = live[:]
        if cuts and _excluded(m[0], known):
            continue
        for s, e in [*cuts, (end, end)]:
            found += _parts(text[at:s], at, enc, ratio, known)
            at = max(at, e)
    return found


def find_secrets(docs: DataFrame, tokens: str = "byte_bpe_50k.tiktoken", ratio: float = RATIO, known_digests: tuple[str, ...] = (),
                 doc_id: str = "doc_id", text: str = "text", redact: str | None = None) -> DataFrame:
    """Per row: doc_id, spans array<struct<kind,start,end>>, ordered by start, then kind; with
    ``redact`` also the text with every span replaced by it (overlapping spans by one)."""
    known = frozenset(x.lower() for x in known_digests)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        enc = encoding(tokens)
        for batch in batches:
            for at, part in texts(batch.column(1)):
                spans, clean = [], []
                for t in part:
                    base = pattern_spans(t)
                    all_ = sorted(base + random_spans(t, base, enc, ratio, known))
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_])
                    if redact is not None:
                        clean.append(_without(t, all_, redact))
                columns = [batch.column(0).slice(at, len(part)), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if redact is not None else []),
                                                 names=["doc_id", "spans", "text"][: 2 + (redact is not None)])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>" + (", text string" if redact is not None else "")
    return source.mapInArrow(run, schema)


def _without(text: str, spans: list[tuple[int, int, int]], redact: str) -> str:
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], redact]
        done = max(done, b)
    return "".join([*out, text[done:]]) if spans else text


def redactor(tokens: str = "byte_bpe_50k.tiktoken", ratio: float = RATIO, known_digests: tuple[str, ...] = (), redact: str = "[SECRET]"):
    """A column function: text -> text without its secrets (null stays null)."""
    known = frozenset(x.lower() for x in known_digests)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        enc = encoding(tokens)
        parts = []
        for at in range(0, len(column), 256):  # slices, so that a batch never exists twice as Python text
            out = []
            for t in column.slice(at, 256).to_pylist():
                base = pattern_spans(t) if t else []
                out.append(_without(t, sorted(base + random_spans(t, base, enc, ratio, known)), redact) if t else t)
            parts.append(pa.array(out, pa.string()))
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return clean


def joined(spans, kinds: list[str]):
    """kind:start:end of the chosen kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


