"""Secret scans by lexing assignments."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from feedlake.llm.common import map_texts
from feedlake.session import ship

ship(__name__)

KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# A run of these letters is taken whole, so asking for 24 at once finds the same runs.
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names that tell a secret, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "signature": 0.6, "salt": 0.6,
    "auth": 0.6, "cookie": 0.6, "pin": 0.5,
}
#: Two neighbouring parts that tell a secret only together.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0,
                   ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("connection", "string"): 0.7}
#: Parts that tell a value about a secret, not the secret.
HARMLESS = {"count", "length", "len", "size", "type", "name", "field", "label", "hint", "url", "uri", "path", "file",
            "expiry", "expires", "ttl", "limit", "max", "min", "enabled", "required", "id", "policy", "env", "header"}
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|todo|changeme|change_me|example|placeholder|redacted|your.*|<.*>|\$\{?.*|%.*%|\{\{.*)$"
)
THRESHOLD = 0.5

#: One of these is in every name that scores; a text without any needs no lexing.
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "salt", "cookie", "signature", "pin",
         "string")

STATEMENT = re.compile(
    r"""(?:(?<=^)|(?<=[\s{,;(\[]))                              # start of a statement, pair or argument
        (?P<q>["']?)(?P<name>[A-Za-z_][\w.-]*)(?P=q)            # a name, perhaps quoted
        (?:\x20?:\x20?[A-Za-z_][\w.\[\]]*(?=\x20?=[^=>]))?      # a type
        [\x20\t]*(?:=>|:=|=(?!=)|:(?!:))[\x20\t]*
        (?P<value>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s"'`,;(){}\[\]|\#]+)""",
    re.MULTILINE | re.VERBOSE,
)
MORE = re.compile(r"""[\x20\t]*(?:\+|\.\.)[\x20\t]*("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_][\w.]*)""")
IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How surely a value of this name is a secret, 0 to 1."""
    parts = [p.lower() for p in CAMEL.findall(name)]
    score = max([SENSITIVE.get(p, 0.0) for p in parts], default=0.0)
    score = max([score, *(SENSITIVE_PAIRS.get(pair, 0.0) for pair in zip(parts, parts[1:]))])
    return score * 0.3 if parts and parts[-1] in HARMLESS else score


def literal_score(text: str) -> float:
    """How much a literal looks like a secret: by length, placeholder words and bits per character."""
    if len(text) < 6 or PLACEHOLDER.match(text) or any(c.isspace() for c in text):
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    mixed = any(c.isdigit() for c in text) or any(not c.isalnum() for c in text)
    return min(1.0, bits / 3.0) * (1.0 if mixed or bits >= 3.5 else 0.6)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def _unquoted(text: str, start: int, end: int) -> tuple[int, int]:
    return (start + 1, end - 1) if text[start] in "\"'`" else (start, end)


def assigned_literals(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of every literal that reaches a name.

    A value that is itself a name stands for the literals that name held last, and parts
    joined by ``+`` count each, so a literal is listed for every name it was passed on to.
    """
    held: dict[str, list[tuple[int, int]]] = {}
    found = []
    at = 0
    while m := STATEMENT.search(text, at):
        pieces, end = [(m.start("value"), m.end("value"))], m.end()
        while more := MORE.match(text, end):
            pieces.append(more.span(1))
            end = more.end()
        values = []
        for a, b in pieces:
            piece = text[a:b]
            if piece[0] not in "\"'`" and IDENTIFIER.match(piece) and piece in held:
                values += held[piece]
            else:
                values.append(_unquoted(text, a, b))
        # Each literal once: names that add themselves up would double the list at every line.
        held[m["name"]] = values = list(dict.fromkeys(values))
        found += [(m["name"], a, b) for a, b in values]
        at = max(end, m.start() + 1)
    return found


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, str, int]]:
    """Literals whose name and looks together pass the threshold."""
    if "=" not in text and ":" not in text:
        return []
    lower = text.lower()
    if not any(stem in lower for stem in STEMS):
        return []
    return sorted({
        (a, "literal", b)
        for name, a, b in assigned_literals(text)
        if name_score(name) * literal_score(text[a:b]) >= threshold
    })


def joined(spans: list[tuple[int, str, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan_texts(texts: list[str | None], threshold: float = THRESHOLD) -> tuple[list, ...]:
    n = {kind: [] for kind in KINDS[:3]}
    digests, spans = [], []
    for text in texts:
        base = base_spans(text or "")
        kinds = Counter(kind for _, kind, _ in base)
        for kind in n:
            n[kind].append(kinds[kind])
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(base + literal_spans(text or "", threshold)))
    return (*n.values(), digests, spans)


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and the secrets of the text.

    Adds n_assign, n_access, n_hex (long), base_sha256 and spans (string); spans are
    ``kind:start:end`` in code points, end exclusive, ordered by start, then kind. Null text
    counts as empty: no spans, the digest of the empty text. A column of ``docs`` that has
    the name of an added one is left out. Rows are independent, so repeated rows give
    repeated results and an empty table gives none.
    """
    outputs = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    keep = [c for c in docs.columns if c != text and c.lower() not in outputs]

    def setup():
        return lambda texts: scan_texts(texts, threshold)

    return map_texts(docs, keep, [text], outputs, setup)
