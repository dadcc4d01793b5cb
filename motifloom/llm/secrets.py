"""Secrets in texts: patterns, and candidates confirmed by what they decode to.

Three kinds are found by pattern (assign, access, hex). Further candidates are
reported only if their bytes have the structure of a key or a token: a DER
private key whose nested lengths add up (der; encrypted ones too), an OpenSSH
private key with its length-prefixed fields (openssh), or a signed token whose
first part is a JSON header that names an algorithm (jwt). Base64 is decoded from
every place where the first bytes of a key can stand, over line breaks, as far as
the key's own lengths say; hex likewise within its run. PEM blocks are decoded
from between their markers, also where the block itself is in base64. Spans are
in code points, end exclusive.

Edge cases: a null or empty text has no spans; all texts are read whole, in time
that grows with their length; each row is searched by itself, so repeated rows and
ids have equal spans; spans that begin alike are in the order of KINDS; an empty
table gives no rows; other columns are not read, and pass through redact unchanged.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, short_slices

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[^\n]*")
_DEK = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,[0-9A-Fa-f]{16,}")
#: What may part the lines of a body: line breaks, as they are or escaped, with the blanks around them.
_BREAK = re.compile(r"[ \t]*(?:\\+[rn]|[\r\n])(?:\\+[rnt]|\s)*")
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: Where a DER sequence, the OpenSSH magic or a PEM marker (after 0, 1 or 2 bytes of its group of three) may begin.
_DER_64 = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{14})")
_SSH_64 = re.compile("b3BlbnNzaC1rZXktdjEA")
_PEM_64 = re.compile("(LS0tLS1CRUdJTi)|(0tLS0tQkVHSU4g)|(tLS0tLUJFR0lOI)")
_DER_HEX = re.compile(r"30(?:[0-7].|81..|82.{4}|83.{6})(?:0201|30)", re.IGNORECASE)
_SSH_HEX = re.compile(r"6f70656e7373682d6b65792d763100", re.IGNORECASE)
#: Three or more parts with dots between them; each run of letters is looked at once.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++){2,}+")
_HEADER_64 = re.compile("e(?:y[ABIJ]|w[klop01])")  # a brace and a quote or blank: where a JSON object may begin
_HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{64,}+|(?<![0-9A-F])[0-9A-F]{64,}+")
_SSH_MAGIC = b"openssh-key-v1\0"
_BY_PASSWORD = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _unbase64(s: str) -> bytes:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag and content of each value in data, if their lengths fill it exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_private_key(data: bytes, encrypted: bool = False) -> bool:
    """A DER sequence in one of the usual private-key layouts. encrypted: known to be a key under a password."""
    outer = _der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = _der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if tags == [0x30, 0x04]:  # algorithm, encrypted key; the algorithm is one of PKCS #5 or #12
        inner = _der_items(items[0][1])
        return bool(inner) and inner[0][0] == 0x06 and (encrypted or inner[0][1].startswith(_BY_PASSWORD))
    if items[0][0] != 0x02 or len(items[0][1]) != 1:
        return False
    if len(tags) >= 9 and tags[:9] == [0x02] * 9:  # version and eight numbers
        return True
    if tags == [0x02] * 6 and items[0][1] == b"\0":  # DSA: version, three parameters, public and private number
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, key
        inner = _der_items(items[1][1])
        return bool(inner) and inner[0][0] == 0x06
    return tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and len(items[1][1]) >= 16  # version 1, scalar


def _openssh_size(data: bytes) -> int | None:
    """The bytes of the OpenSSH private key that data begins with: the magic, three strings, a key count, as many public keys, the private part."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= count <= 16 and all(string() for _ in range(count)) and string() else None


def is_openssh_private_key(data: bytes) -> bool:
    """The magic, three strings, a key count and as many public keys with lengths that fit."""
    return _openssh_size(data) is not None


def _json_object(letters: str) -> dict | None:
    try:
        found = json.loads(_unbase64(letters))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(token: str) -> bool:
    """Three parts: a JSON object that names an algorithm other than none, a JSON object, a signature."""
    head, body, signature = token.split(".")
    header = _json_object(head) if signature else None
    return header is not None and isinstance(header.get("alg"), str) and header["alg"].lower() != "none" and _json_object(body) is not None


def _begins_object(letters: str, at: int) -> bool:
    """Whether the letters from a place on decode to a JSON object, as far as growing pieces of them tell."""
    size = 64
    while True:
        piece = _unbase64(letters[at : at + size]).decode("utf-8", "replace")
        try:
            json.JSONDecoder().raw_decode(piece)
            return True
        except json.JSONDecodeError as e:
            if at + size >= len(letters) or e.pos < len(piece) - 8 and not e.msg.startswith("Unterminated"):
                return False
        except RecursionError:
            return False
        size *= 2


def _token_spans(text: str) -> list[Span]:
    """Signed tokens: three parts of a dotted run, the first from any place where its JSON can begin."""
    out: list[Span] = []
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        places = [at]
        for part in parts:
            places.append(places[-1] + len(part) + 1)
        i = 0
        while i + 2 < len(parts):
            head, signed = parts[i], False
            for m in _HEADER_64.finditer(head):
                if _begins_object(head, m.start()) and is_signed_token(f"{head[m.start() :]}.{parts[i + 1]}.{parts[i + 2]}"):
                    out.append((places[i] + m.start(), 5, places[i + 2] + len(parts[i + 2])))
                    signed = True
                    break
            i += 3 if signed else 1
    return out


def _key_kind(data: bytes, encrypted: bool = False) -> int | None:
    if is_der_private_key(data, encrypted):
        return 3
    return 4 if is_openssh_private_key(data) else None


def _der_size(head: bytes) -> int | None:
    """The bytes of the sequence that head begins, if what it holds begins as a private key does."""
    if head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + width], "big"), 2 + width
    inner = head[at : at + 3]
    return at + n if inner in (b"\2\1\0", b"\2\1\1") or inner[:1] == b"\x30" else None


class _Joined:
    """The base64 letters of text from a place on, over line breaks; as many as are wanted, or all."""

    def __init__(self, text: str, at: int, want: int | None = None) -> None:
        self.text, parts, self.starts, self.places, self.size = text, [], [], [], 0
        while (m := _LETTERS.match(text, at)) and (want is None or self.size < want):
            self.starts.append(self.size)
            self.places.append(m.start())
            parts.append(m[0] if want is None else m[0][: want - self.size])
            self.size += len(parts[-1])
            if not (gap := _BREAK.match(text, m.end())):
                break
            at = gap.end()
        self.letters = "".join(parts)

    def bytes(self) -> bytes:
        return _unbase64(self.letters[: len(self.letters) - (len(self.letters) % 4 == 1)])

    def end(self, n: int) -> int:
        """Where in the text the nth letter ends, with the signs that fill its group up."""
        k = bisect.bisect_left(self.starts, n) - 1
        at = self.places[k] + n - self.starts[k]
        for _ in range(-n % 4):
            at += self.text[at : at + 1] == "="
        return at

    def place(self, n: int) -> int:
        k = bisect.bisect_right(self.starts, n) - 1
        return self.places[k] + n - self.starts[k]


def _letters_of(n: int) -> int:
    return -(-4 * n // 3)


def _pem_spans(text: str) -> list[Span]:
    """Blocks between markers whose body is a key, or is said to be enciphered and has whole blocks of bytes."""
    out: list[Span] = []
    for m in _PEM.finditer(text):
        mark = f"-----END {m[1]}-----"
        until = text.find("-----", m.end())
        if until < 0 or not text.startswith(mark, until):
            continue
        lines = [x.strip() for x in re.split(r"(?:\\+[rn]|[\r\n])+", text[m.end() : until])]
        headers = [x for x in lines if _HEADER.fullmatch(x)]
        data = _unbase64(re.sub(r"\\+t|[\s\\]", "", "".join(x for x in lines if not _HEADER.fullmatch(x))))
        kind = _key_kind(data, m[1].startswith("ENCRYPTED"))
        if kind is None and data and len(data) % 8 == 0 and any("ENCRYPTED" in x for x in headers) and any(_DEK.match(x) for x in headers):
            kind = 3
        if kind is not None:
            out.append((m.start(), kind, until + len(mark)))
    return out


def _wrapped_pem_spans(text: str) -> list[Span]:
    """PEM blocks that are themselves in base64."""
    out: list[Span] = []
    until = 0
    for m in _PEM_64.finditer(text):
        before = (0, 2, 3)[m.lastindex - 1]  # letters of the group that come before
        if m.start() < until or not _LETTERS.fullmatch(text, m.start() - before, m.end()):
            continue
        own = _Joined(text, m.start() - before)
        inner = own.bytes().decode("latin-1")
        for a, kind, b in _pem_spans(inner):
            last = own.size if not inner[b:].strip() else _letters_of(b)
            until = own.end(last)
            out.append((own.place(4 * a // 3), kind, until))
    return out


def _base64_spans(text: str, inside: list[tuple[int, int]]) -> list[Span]:
    """Keys in base64 without markers, wherever their first bytes stand."""
    out: list[Span] = []
    until = 0
    for m in sorted([*_DER_64.finditer(text), *_SSH_64.finditer(text)], key=re.Match.start):
        at = m.start()
        if at < until or any(a <= at < b for a, b in inside):
            continue
        if m[0] == "M":
            size = _der_size(_unbase64(text[at : at + 16]))
            if size is None or _letters_of(size) > len(text) - at:
                continue
            own = _Joined(text, at, _letters_of(size))
            found = own.size == _letters_of(size) and is_der_private_key(own.bytes()[:size])
        else:
            own = _Joined(text, at)
            size = _openssh_size(own.bytes())
            found = size is not None
        if found:
            until = own.end(_letters_of(size))
            out.append((at, 3 if m[0] == "M" else 4, until))
    return out


def _hex_spans(s: str, at: int) -> list[Span]:
    out: list[Span] = []
    until = 0
    for m in sorted([*_DER_HEX.finditer(s), *_SSH_HEX.finditer(s)], key=re.Match.start):
        if m.start() < until:
            continue
        der = m[0][0] == "3"
        whole = len(s) - (len(s) - m.start()) % 2
        size = _der_size(bytes.fromhex(s[m.start() : min(m.start() + 24, whole)])) if der else None
        if der and (size is None or m.start() + 2 * size > whole):
            continue
        data = bytes.fromhex(s[m.start() : m.start() + 2 * size if der else whole])
        size = size if der else _openssh_size(data)
        if size is not None and size <= len(data) and (not der or is_der_private_key(data[:size])):
            until = m.start() + 2 * size
            out.append((at + m.start(), 3 if der else 4, at + until))
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded bytes have the structure of a key or a signed token."""
    out = _pem_spans(text) if "-----BEGIN" in text else []
    out += _wrapped_pem_spans(text)
    inside = [(a, b) for a, _, b in out]
    out += _base64_spans(text, inside)
    out += [x for x in _token_spans(text) if not any(a <= x[0] < b for a, b in inside)]
    for run in _RUN.finditer(text):
        if any(a <= run.start() < b for a, b in inside):
            continue
        s, at = run[0], run.start()
        for m in _HEX_RUN.finditer(s):
            out += _hex_spans(m[0], at + m.start())
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with the confirmed ones, each by start and kind."""
    base = base_spans(text)
    return base, sorted({*base, *confirmed_spans(text)})


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, written = np.zeros((len(batch), 3), np.int64), [], []
        for i, text in enumerate(batch.column("text")):
            base, spans = all_spans(text.as_py() or "")
            for _, kind, _ in base:
                counts[i, kind] += 1
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            written.append(_written(spans))
        columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(written, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (kind:start:end, comma-joined) of each row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(_find), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span, and spans that touch it, as one mask."""
    parts, at, until = [], 0, -1
    for a, _, b in all_spans(text)[1]:
        if a > until:
            parts += [text[at:a], mask]
        at = until = max(until, b)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the secrets in text masked; length, if docs has it, follows the new text."""
    at = docs.columns.index(text)
    k = docs.columns.index(length) if length in docs.columns else None
    plain = docs.toDF(*(f"k{i}" for i in range(len(docs.columns))))  # names with a dot can't be handed over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in short_slices(b, at)):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [None if t is None else redacted(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if k is not None:
                kept = columns[k].to_pylist()
                sizes = [n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)]
                columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
