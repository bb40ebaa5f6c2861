"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and long hex runs. Further candidates, found by shape alone, are reported
only if their content parses: base64 and hex runs are decoded and must hold a DER key structure whose nested lengths
add up, or an OpenSSH key whose length-prefixed fields fill it; PEM blocks must decode so; signed tokens must have a
JSON header with ``alg`` and a JSON object as payload. Runs go on over line ends, real or written out as escapes, and
over joints of string literals; a key may begin anywhere in a run and ends where its own lengths say.

One pass over whole texts, no shuffle. Offsets are code points, the end is exclusive. Time is in proportion to a text's
length, whatever it holds: patterns never go back over a run, an armoured block begins at the last header before its
end, and a key's lengths are read in place, so that nothing is decoded that isn't a key.

Defined results: a null text is an empty one, without spans; a null ``doc_id`` is carried through; repeated rows are
scanned one by one; extra columns are kept by ``redact`` and ignored by ``scan``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._text import text_slices

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
# Keys are often wrapped, pasted with their line ends written out, or cut into string literals.
_GAP = r"""(?:\s|\\{1,8}[nrt]|\\{1,8}(?=/)|["']\s*+(?:[+,.\\]\s*+)?["'])"""
_GAPS = re.compile(_GAP + "+")
_HEX_GAPS = re.compile(r"(?:[:\s]|\\{1,8}[nrt]|\\{1,8}x)+")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}PRIVATE KEY)-----")
_ARMOURED = re.compile(r"""[A-Za-z0-9+/=\s:,.\\"'-]*""")
_B64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]|\\{{1,8}}/){{20,}}+(?:{_GAP}++[A-Za-z0-9+/_-]++)*+")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2,}+(?:(?:[:\s]|\\{1,8}[nrt]|\\{1,8}x)++[0-9A-Fa-f]++)*+")
#: Where a key may begin: the head of a DER sequence with a version number, or OpenSSH's magic.
_B64_HEAD = re.compile(r"M[A-H].CA[Q-Za-f]|MI[E-T]|b3BlbnNzaC1rZXktdjEA")
_HEX_HEAD = re.compile(r"30(?:[0-7].|81..|82.{4}|83.{6}|84.{8})0201|6f70656e7373682d6b65792d763100")
#: Characters of the shortest key that is looked for.
_B64_LEAST, _HEX_LEAST = 48, 64
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?=\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+))")
_TOKEN_HEAD = re.compile("(?=e[yw])")
_JSON = json.JSONDecoder()
_OBJECT = re.compile(r"""\{[ \t\r\n]*+(?:\}|"(?:[^"\\\x00-\x1f]|\\.)*+"[ \t\r\n]*+:)""")

#: Kinds in the order that breaks ties between spans with the same start; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE = 3


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, those that fail its length dropped."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is a maximal run, so asking for the length in the pattern finds the same spans.
    out += [("hex", m.start(), m.end()) for m in _HEX_LONG.finditer(text)]
    return out


class Encoded:
    """Bytes of a run of hex or standard base64 characters from one place on; reads decode only what they ask for."""

    def __init__(self, run: str, start: int, bits: int):
        self.run, self.start, self.bits = run, start, bits
        self.head = self._decoded(0, 72)

    def __len__(self) -> int:
        return (len(self.run) - self.start) * self.bits // 8

    def _decoded(self, at: int, n: int) -> bytes:
        if self.bits == 4:
            part = self.run[self.start + 2 * at : self.start + 2 * (at + n)]
            return bytes.fromhex(part[: len(part) // 2 * 2])
        part = self.run[self.start + at // 3 * 4 : self.start + -(-(at + n) // 3) * 4]
        if len(part) % 4 == 1:
            part = part[:-1]
        return binascii.a2b_base64(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]

    def read(self, at: int, n: int) -> bytes:
        return self.head[at : at + n] if at + n <= len(self.head) else self._decoded(at, n)


class Plain:
    """Bytes that are there already."""

    def __init__(self, data: bytes):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


def _der(data: Encoded | Plain, at: int, limit: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at ``at``, or None if it doesn't end by ``limit``."""
    head = data.read(at, 6)
    if len(head) < 2:
        return None
    tag, size, at = head[0], head[1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= limit else None


#: A key has no more elements than this: a version, eight numbers, further primes, attributes.
_MOST_ELEMENTS = 16


def _der_key(data: Encoded | Plain) -> int:
    """Bytes of the private key at the start of data, 0 if there is none: one DER sequence that its elements fill exactly, an integer version first, then key numbers, a named algorithm with an octet string, or an EC octet string."""
    whole = _der(data, 0, len(data))
    if whole is None or whole[0] != 0x30:
        return 0
    tags, at, end, size = [], whole[1], whole[2], 0
    while at < end:
        found = _der(data, at, end)
        if found is None or len(tags) == _MOST_ELEMENTS:
            return 0
        tag, start, at = found
        tags.append(tag)
        size += at - start
        if len(tags) == 1:
            fine = tag == 0x02 and at - start == 1
        elif len(tags) == 2:
            # What follows the version tells which kind of key it may be.
            fine = tag == 0x02 or tag == 0x04 and at - start >= 20 or tag == 0x30 and _named(data, start, at)
        elif tags[1] == 0x02:
            fine = tag in (0x02, 0x30)
        else:
            fine = tags[1] == 0x30 and (len(tags) > 3 or tag == 0x04) or tags[1] == 0x04 and tag in (0xA0, 0xA1)
        if not fine:
            return 0
    enough = {0x02: len(tags) >= 6 and size >= 32, 0x30: len(tags) >= 3, 0x04: True}
    return end if len(tags) > 1 and enough[tags[1]] else 0


def _named(data: Encoded | Plain, start: int, end: int) -> bool:
    """Whether elements that fill data[start:end] begin with an object identifier."""
    first, n = None, 0
    while start < end:
        found = _der(data, start, end)
        if found is None or n == _MOST_ELEMENTS:
            return False
        first, start, n = found[0] if first is None else first, found[2], n + 1
    return first == 0x06


_MAGIC = b"openssh-key-v1\x00"


def _ssh_key(data: Encoded | Plain) -> int:
    """Bytes of the OpenSSH private key at the start of data, 0 if there is none: magic, then three fields, a number of public keys, these and the private part, each with its length before it."""
    if data.read(0, len(_MAGIC)) != _MAGIC:
        return 0
    at, fields, number = len(_MAGIC), 3, None
    while fields:
        size = data.read(at, 4)
        if len(size) < 4:
            return 0
        at += 4 + int.from_bytes(size, "big")
        fields -= 1
        if not fields and number is None:
            count = data.read(at, 4)
            number = int.from_bytes(count, "big")
            if len(count) < 4 or not 1 <= number <= 16:
                return 0
            at, fields = at + 4, number + 1
    return at if at <= len(data) else 0


def is_der_key(data: bytes) -> bool:
    """Whether data is a private key in DER, and nothing else."""
    return bool(data) and _der_key(Plain(data)) == len(data)


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key, and nothing else."""
    return bool(data) and _ssh_key(Plain(data)) == len(data)


_STANDARD = str.maketrans("-_", "+/")


def _b64(text: str) -> bytes | None:
    text = text.translate(_STANDARD).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _hidden_keys(text: str, start: int, end: int, gaps: re.Pattern, head: re.Pattern, bits: int, least: int) -> Iterator[Span]:
    """Keys inside the run text[start:end] of encoded characters with ``gaps`` between: from each place that looks like a key's head, nested lengths are followed to the key's end."""
    pieces, places, offsets, size = [], [], [], 0
    for gap_start, gap_end in [*((g.start(), g.end()) for g in gaps.finditer(text, start, end)), (end, end)]:
        if gap_start > start:
            pieces.append(text[start:gap_start])
            places.append(start)
            offsets.append(size)
            size += gap_start - start
        start = gap_end
    if size < least:
        return
    run = "".join(pieces)
    run = run.lower() if bits == 4 else run.translate(_STANDARD)
    place = lambda i: (k := bisect_right(offsets, i) - 1, places[k] + i - offsets[k])[1]
    at = 0
    while m := head.search(run, at):
        at = m.start() + 1
        data, der = Encoded(run, m.start(), bits), run[m.start()] in "M3"
        chars = -(-(_der_key(data) if der else _ssh_key(data)) * 8 // bits)
        if chars >= least:
            at = m.start() + chars
            yield "der_key" if der else "ssh_key", place(m.start()), place(at - 1) + 1


def _pem_body(body: str) -> str:
    """The encoded part of a PEM block: line ends that were written out are lines, string literals are joined, headers end at the blank line after them."""
    body = re.sub(r"\\{1,8}r\\{1,8}n|\\{1,8}[nr]|\r\n?", "\n", re.sub(r"\\{1,8}/", "/", body))
    body = re.sub(r"""["'][^\S\n]*+(?:[+,.\\]\s*+)?["']""", "", body).replace("\\t", " ")
    lines = [x.strip(" \t\"'\\") for x in body.split("\n")]
    heads = [i for i, x in enumerate(lines) if ":" in x]
    if not heads:
        return "".join("".join(lines).split())
    rest = lines[heads[-1] + 1 :]
    while rest and not rest[-1]:
        rest.pop()
    if "" in rest:
        rest = rest[rest.index("") :]
    return "".join("".join(rest).split()) or "".join(x for x in body.split() if len(x) >= 32 and ":" not in x)


def is_signed_token(text: str) -> bool:
    """Whether text is header.payload.signature with a JSON header that names ``alg`` and a JSON object as payload."""
    header, payload, signature = text.split(".")
    try:
        head, body = (json.loads(_b64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    sealed = _b64(signature) if signature else None
    return head["alg"].lower() == "none" or bool(sealed) and len(sealed) >= 16


def confirmed_spans(text: str) -> list[Span]:
    """Candidates that parse."""
    out: list[Span] = []
    if "-----BEGIN " in text:
        out += _armoured(text)
    for m in _B64.finditer(text):
        for kind, start, end in _hidden_keys(text, m.start(), m.end(), _GAPS, _B64_HEAD, 6, _B64_LEAST):
            padding = len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
            out.append((kind, start, end + padding))
    for m in _HEX_ANY.finditer(text):
        if m.end() - m.start() >= _HEX_LEAST:
            out += _hidden_keys(text, m.start(), m.end(), _HEX_GAPS, _HEX_HEAD, 4, _HEX_LEAST)
    if "." in text and ("ey" in text or "ew" in text):
        out += _tokens(text)
    return out


def _armoured(text: str) -> Iterator[Span]:
    """PEM blocks that hold a key, or say that it is encrypted: each from the last header before its end."""
    opened = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            opened = m
            continue
        if opened and opened[2] == m[2]:
            body = text[opened.end() : m.start()]
            data = _b64(_pem_body(body)) if _ARMOURED.fullmatch(body) else None
            if _key_kind(data) or data and "ENCRYPTED" in (m[2] + body):
                yield "pem_key", opened.start(), m.end()
        opened = None


def _tokens(text: str) -> Iterator[Span]:
    """Signed tokens that begin at any place of a segment where a JSON object may."""
    done = 0
    for m in _TOKEN.finditer(text):
        if m.start() < done:
            continue
        for start in _headers(m[0]):
            if not _is_object(m[1]):
                break
            if len(m[0]) - start >= 10 and is_signed_token(text[m.start() + start : m.end(2)]):
                yield "signed_token", m.start() + start, m.end(2)
                done = m.end(2)
                break


def _headers(part: str) -> Iterator[int]:
    """Places from which part, decoded, is a JSON object up to its end. Places four characters apart share one decoding."""
    decoded: dict[int, str] = {}
    for m in _TOKEN_HEAD.finditer(part):
        phase, at = m.start() % 4, m.start() // 4 * 3
        if phase not in decoded:
            data = (_b64(part[phase:]) or b"").decode("latin-1").rstrip(" \t\r\n")
            decoded[phase] = data if data.endswith("}") and ('"alg"' in data or "\\u" in data) else ""
        data = decoded[phase]
        if not _OBJECT.match(data, at):
            continue
        try:
            if _fills(data, at):
                yield m.start()
        except RecursionError:  # nested deeper than any header
            return


def _fills(data: str, at: int) -> bool:
    """Whether data[at:] is one JSON object. Errors are looked for in a growing window, as each costs time in proportion to it."""
    size = 512
    while True:
        part = data[at : at + size]
        try:
            return _JSON.raw_decode(part)[1] == len(data) - at
        except json.JSONDecodeError as e:
            if len(part) < size or e.pos < size - 16 and not e.msg.startswith("Unterminated"):
                return False
        size *= 4


def _is_object(part: str) -> bool:
    try:
        return isinstance(json.loads(_b64(part) or b""), dict)
    except (ValueError, RecursionError):
        return False


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str | None) -> list[Span]:
    """All spans of a text, base ones first confirmed by pattern, the others by structure; ordered by start and kind."""
    text = text or ""
    return _ordered(base_spans(text) + confirmed_spans(text))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every document, one row per input row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``scan`` gives."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:BASE]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans share one mark. ``n_chars``, if there, is counted anew where the text changed."""
    schema = docs.schema
    counted = "n_chars" in docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, start, end in find(text):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mark]
            at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            before = batch.column("text").to_pylist()
            after = [clean(t) for t in before]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(after, batch.schema.field("text").type))
            if counted:
                at = batch.schema.get_field_index("n_chars")
                sizes = [len(b) if b is not None and a != b else n for a, b, n in zip(before, after, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, schema)


def base_digest(text: str | None) -> str:
    """base_sha256 of one text, for tests and small uses."""
    return hashlib.sha256(joined(_ordered(base_spans(text or ""))).encode()).hexdigest()
