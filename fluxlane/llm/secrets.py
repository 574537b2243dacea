"""Secret scans with multipart credential linking.

Four kinds are certain by themselves and always reported: ``assign`` (the
value of a password, secret, token or key), ``access`` (an access key id),
``hex`` (a long hexadecimal run). Weak parts say nothing alone:

* ``ident``: a user name or client id that is assigned a value,
* ``opaque``: a run of 32 or more base-64 characters that mixes cases and digits,
* ``endpoint``: the host of a URL or of a host, server or endpoint setting.

An interval join puts parts into scopes: the intervals between blank lines. In
a scope a weak secret is reported if an identifier (access, ident) is there too,
an identifier if a secret (opaque, assign, hex) is, and an endpoint if both an
identifier and a secret are. A part that runs over a blank line belongs to every
scope it meets. Parts and scopes are sorted, so the join is linear but for that.

Null text counts as empty and gives no span. Offsets are code points, ends
exclusive. Rows are scanned one by one: ties, repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import in_batches

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.A | re.I)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}")
_ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://(?:[^\s/@:"']+(?::[^\s/@"']+)?@)?|(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)""", re.A | re.I)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The certain spans, by start and then kind: (start, end, kind)."""
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2]), s[1]


def _scopes(spans: list[Span], cuts: list[int]) -> list[range]:
    """The scopes, by number, that each span meets; ``cuts``: where scopes but the first start."""
    return [range(bisect.bisect_right(cuts, start), bisect.bisect_left(cuts, end) + 1) for start, end, _ in spans]


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(certain spans, all spans)."""
    text = text or ""
    base = base_spans(text)
    opaque = [(m.start(), m.end(), "opaque") for m in _OPAQUE.finditer(text) if _mixed(m[0])]
    low = text.lower()
    ident = [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)] if any(w in low for w in ("user", "login", "client", "account")) else []
    secrets = sorted([*opaque, *(s for s in base if s[2] in ("assign", "hex"))])
    identifiers = sorted([*ident, *(s for s in base if s[2] == "access")])
    if not secrets or not identifiers:
        return base, base
    cuts = [m.end() for m in _BLANK.finditer(text)]
    with_secret, with_identifier = ({n for r in _scopes(spans, cuts) for n in r} for spans in (secrets, identifiers))
    ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    weak = []
    for parts, needed in ((opaque, with_identifier), (ident, with_secret), (ends, with_secret & with_identifier)):
        weak += [s for s, r in zip(parts, _scopes(parts, cuts), strict=True) if any(n in needed for n in r)]
    return base, sorted([*base, *weak], key=_order)


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None) -> str | None:
    """The text with every reported span replaced by its kind; spans that overlap go together."""
    spans = find_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text)
                for k, v in counts.items():
                    v.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            out = {"doc_id": batch.column("doc_id")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            yield pa.record_batch(out | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(documents: DataFrame) -> DataFrame:
    """All rows and columns, with secrets taken out of ``text`` and n_chars put right."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            texts = [redact(t) for t in batch.column("text").to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                was = columns[at].to_pylist()
                columns[at] = pa.array([n if n is None or t is None else len(t) for n, t in zip(was, texts, strict=True)], batch.schema.field("n_chars").type)
            yield pa.record_batch(columns, names=names)

    return documents.mapInArrow(run, documents.schema)
