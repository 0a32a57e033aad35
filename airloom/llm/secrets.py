"""Secret scans: every text and every layer that decoding it reveals, with spans mapped back to the text."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from airloom.llm.common import texts

KINDS = ("assign", "access", "hex")
MOST_BYTES = 64 << 20  # of one unpacked layer; a larger one is counted in ``oversize`` and not scanned

# The three kinds of secret.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
UNICODE_ONE = re.compile(r"\\u\{?([0-9A-Fa-f]{1,6})\}?|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Lines of one run that was wrapped: full ones, and a last one of any length.
WRAPPED_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{16,}+)*"
                         r"\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++={0,2}")
SEPARATOR = re.compile(r"[/_-]+")

Span = tuple[str, int, int]


def find_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind in ``text`` itself, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in _assigned(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits is one match whatever its length, so asking for 24 in the pattern drops the same ones.
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _assigned(text: str) -> Iterator[re.Match]:
    small = text.lower() if text.isascii() else text.encode("ascii", "replace").decode().lower()
    return ASSIGN.finditer(text) if any(word in small for word in KEYWORDS) else iter(())


@dataclass
class Layer:
    """A decoded text; ``starts`` and ``ends`` give the span of the first text each of its characters came from."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def _unescaped(run: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
        return chr(code) if code < 0x110000 else m[0]

    # Two escapes may make one character beyond the first 65,536.
    return UNICODE_ONE.sub(one, run).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of ``pattern`` decoded in its place, or nothing if none decodes."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        made = decode(m[0])
        if made is None or made == m[0]:
            continue
        first, last = layer.starts[m.start()], layer.ends[m.end() - 1]
        parts += [layer.text[at:m.start()], made]
        starts += [layer.starts[at:m.start()], np.full(len(made), first, np.int32)]
        ends += [layer.ends[at:m.start()], np.full(len(made), last, np.int32)]
        at = m.end()
    if not parts:
        return None
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, layer.starts[at:]]),
                 np.concatenate([*ends, layer.ends[at:]]))


class Oversize(Exception):
    pass


def _unpacked(raw: bytes) -> bytes | None:
    """Content of zlib or gzip data, None for other data."""
    if not (raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78"):
        return None
    inflate = zlib.decompressobj(wbits=47)
    try:
        made = inflate.decompress(raw, MOST_BYTES)
    except zlib.error:
        return None
    if inflate.unconsumed_tail:
        raise Oversize
    return made if inflate.eof else None


def _bytes_of(run: str) -> bytes | None:
    bare = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        bare = bare[:-1]  # six bits are no byte
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4))
    except binascii.Error:
        return None


def _packed(head: bytes) -> bool:
    """Whether zlib or gzip data may begin so; two bytes are enough to tell."""
    return head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0)


def _text_of(raw: bytes) -> str:
    """The bytes as text through any compression; bytes that are not UTF-8 become U+FFFD."""
    seen = set()
    while (inner := _unpacked(raw)) is not None and (mark := hashlib.sha256(inner).digest()) not in seen:
        seen.add(mark)
        raw = inner
    return raw.decode(errors="replace")


def _plain(raw: bytes) -> bool:
    """Whether a layer is text as it stands: a first guess only, other layers count if scanning them finds something."""
    try:
        return all(c.isprintable() or c in "\t\n\r" for c in raw.decode())
    except UnicodeDecodeError:
        return False


def _tells(text: str) -> bool:
    """Whether a text holds a secret, or a coded run that does when decoded further."""
    if find_spans(text):
        return True
    return any(made not in (None, m[0]) and _tells(made)
               for pattern, decode in ((URL_RUN, urllib.parse.unquote), (UNICODE_RUN, _unescaped), (BASE64_RUN, _from_base64))
               for m in pattern.finditer(text) for made in [decode(m[0])])


def _from_base64(run: str) -> str | None:
    """Text in a base64 run, through any compression; None if no reading of it holds text or tells a secret.

    The whole run is read first. Where that gives no text, the parts after each separator and the other three
    alignments are tried, since a run may be glued to a word, a path or an escape before it; what precedes
    the reading stays as it is.
    """
    raw = _bytes_of(run)
    if raw is not None:
        if _plain(raw):
            return raw.decode()
        text = _text_of(raw)
        if _unpacked(raw) is not None or _tells(text):
            return text
    # Plain text after any separator appears in one of the alignments; only packed data has to start at its own place.
    packed = [m.end() for m in SEPARATOR.finditer(run) if _packed(_bytes_of(run[m.end():m.end() + 4]) or b"")]
    for start in [1, 2, 3, *packed]:
        if len(run) - start < 16:
            continue
        raw = _bytes_of(run[start:])
        if raw is not None and _tells(text := _text_of(raw)):
            return run[:start] + text
    return None


def scan(text: str) -> tuple[list[Span], set[Span], int, int]:
    """Spans of the text itself, further spans from decoded layers, layers looked at, layers too large to unpack.

    A worklist holds the layers still to unwrap; each decoder makes a new layer in which its runs are replaced in
    place, so that a key before a coded value is seen with it. A layer seen before is not taken up again.
    A find in a layer counts if it touches something decoded, and spans the coded runs it came from.
    """
    base = find_spans(text)
    if not ("%" in text or "\\" in text or "&#" in text or BASE64_RUN.search(text)):
        return base, set(), 1, 0
    at = np.arange(len(text), dtype=np.int32)
    work, seen, found, oversize = [Layer(text, at, at + 1)], {text}, set(), 0

    def inner(run: str) -> str | None:
        nonlocal oversize
        try:
            return _from_base64(run)
        except Oversize:
            oversize += 1
            return None

    while work:
        layer = work.pop()
        for pattern, decode in ((URL_RUN, urllib.parse.unquote), (UNICODE_RUN, _unescaped), (WRAPPED_RUN, inner), (BASE64_RUN, inner)):
            made = _replaced(layer, pattern, decode)
            if made is None or made.text in seen:
                continue
            seen.add(made.text)
            decoded = made.ends - made.starts > 1
            for kind, start, end in find_spans(made.text):
                if decoded[start:end].any():
                    found.add((kind, int(made.starts[start:end].min()), int(made.ends[start:end].max())))
            work.append(made)
    return base, found - set(base), len(seen), oversize


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: ``doc_id, n_assign, n_access, n_hex, base, spans, layers, oversize``.

    ``base`` and ``spans`` are ``kind:start:end`` by start and kind, joined by commas, in code points of the text with
    the end exclusive: ``base`` those of the text as it stands, which the counts are of, ``spans`` with those
    that URL, Unicode, base64 and compressed layers reveal. A null text is empty and has no spans; every row gives a
    row, repeated ones too. Other columns are ignored. Texts have no length limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(spans) -> str:
            return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))

        for batch in batches:
            made = []
            for text in batch["text"]:
                base, more, layers, oversize = scan(text)
                counts = [sum(1 for s in base if s[0] == kind) for kind in KINDS]
                made.append((*counts, told(base), told([*base, *more]), layers, oversize))
            columns = ["n_assign", "n_access", "n_hex", "base", "spans", "layers", "oversize"]
            yield pd.DataFrame(made, columns=columns, index=batch.index).assign(doc_id=batch["doc_id"])

    return texts(docs).mapInPandas(run, "n_assign long, n_access long, n_hex long, base string, spans string, "
                                        "layers long, oversize long, doc_id long")
