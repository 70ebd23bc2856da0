"""Secret scans: patterns, and an assignment-aware lexer.

The lexer reads a text's source and configuration syntax as pairs of a name and an expression of literals and names:
assignments to names, subscripts and fields, with or without a type; arguments that follow a quoted name; options of
commands; elements and attributes of markup; headers; block scalars. Literals may be quoted in any of the usual ways, or
bare. Constants are propagated within their section of a file and from what stands before all sections, so a literal that
reaches a sensitive name through others counts for that name. A literal's score joins how sensitive its target's name is
and how much the literal looks like a secret. Comments are read like all else.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import small_batches, texts

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
_any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_ASSIGN = re.compile(f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive the parts of a name are; a name counts as its most sensitive part or pair of parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "apikey": 0.9, "token": 0.8,
    "credential": 0.8, "credentials": 0.8, "api key": 0.9, "access key": 0.9, "private key": 0.9, "secret key": 1.0,
    "authorization": 0.9, "bearer": 0.9, "auth key": 0.8, "signing key": 0.8, "encryption key": 0.8, "account key": 0.8,
}
_HINTS = tuple(sorted({w.rpartition(" ")[2] if " " in w else w for w in SENSITIVE}))
#: Literals that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "required", "optional", "string", "default"}
_PART = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Literals: in three quotes, in one, in back quotes; a letter or two may stand before them.
_LONG = r'"""(?:[^"\\]|\\.|"(?!""))*+"""|' + r"'''(?:[^'\\]|\\.|'(?!''))*+'''"
_QUOTED = rf"""(?:[A-Za-z@]{{1,2}}(?=["'`]))?(?:(?s:{_LONG})|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`)"""
_REFERENCE = r"\$\{[A-Za-z_][A-Za-z0-9_.-]*\}"
#: A bare value runs on over references in it, as in a${B}c.
_BARE = rf"""(?:[^\s,;#"'`(){{}}\[\]$]++|{_REFERENCE}|\$)+"""
_VALUE = rf"""(?P<value>(?:{_QUOTED}|{_BARE})(?:[ \t]*\+[ \t]*(?:{_QUOTED}|{_REFERENCE}|\$?[A-Za-z_][A-Za-z0-9_.]*))*)"""
_SIGN = r"[ \t]*(?::[ \t]*[A-Za-z_][A-Za-z0-9_.|?\[\]]{0,60}[ \t]*=(?![=>])|:=|=>|=(?!=)|:(?!//))[ \t]*"
#: Pairs whose value is an expression, by what names it.
_PAIRS = [
    re.compile(rf"""(?<![A-Za-z0-9_$.-])(?P<q>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=q){_SIGN}{_VALUE}"""),
    re.compile(rf"""\[[ \t]*(?P<q>["'])(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=q)[ \t]*\][ \t]*(?::=|=(?!=))[ \t]*{_VALUE}"""),
    re.compile(rf"""\([ \t]*(?P<q>["'])(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=q)[ \t]*,[ \t]*(?=["'`])(?P<value>{_QUOTED})"""),
    re.compile(rf"""(?<![A-Za-z0-9_-])--(?P<name>[A-Za-z][A-Za-z0-9-]*+)(?:=|[ \t]+)(?![-=]){_VALUE}"""),
]
_TERM = re.compile(
    rf"""(?:[A-Za-z@]{{1,2}}(?=["'`]))?(?:((?s:{_LONG}))|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`)|\$\{{([A-Za-z_][A-Za-z0-9_.-]*)\}}|\$([A-Za-z_][A-Za-z0-9_]*)|([^\s"'`$+](?:(?!{_REFERENCE})[^\s"'`])*)|\+"""
)
_INNER = re.compile(r"(?<!\\)\$\{([A-Za-z_][A-Za-z0-9_.-]*)\}")
#: Pairs whose value is one literal.
_HEADER = re.compile(r"""(?:(?<![A-Za-z-])(?P<name>[A-Za-z][A-Za-z-]*+)["']?[ \t]*[:=,][ \t]*["']?)?(?<![A-Za-z])(?P<scheme>Bearer|Basic|Token|ApiKey)[ \t]++(?P<literal>[A-Za-z0-9+/_.=~-]++)""")
_BLOCK = re.compile(r"""^(?P<indent>[ \t]*+)(?:-[ \t]+)?["']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?:[ \t]*[|>][0-9+-]*[ \t]*\n(?P<body>(?:(?P=indent)[ \t]+[^\n]*+(?:\n|\Z)|[ \t]*+\n)++)""", re.M)
_LINE = re.compile(r"[^\s][^\n]*")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?P<attributes>(?:\s[^<>]*+)?)>(?:\s*+(?P<literal>[^\s<>][^<>]*+)</)?")
_ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:-]*+)[ \t]*=[ \t]*(?:"([^"<>]*+)"|'([^'<>]*+)')""")
_NAMING = ("key", "name", "id", "property")
_SECTION = re.compile(r"""^[ \t]*\[{1,2}[A-Za-z_][A-Za-z0-9_.: "-]*+\]{1,2}[ \t]*$|^---[ \t]*$""", re.M)


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: long, mixed and unlike a word or placeholder."""
    if len(literal) < 6 or literal.lower() in PLACEHOLDERS or literal[:1] in "<{$" or len(set(literal)) < 4:
        return 0.0
    counts = Counter(literal)
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.25 * min(1, len(literal) / 16) + 0.35 * min(1, bits / 4) + 0.4 * (kinds - 1) / 2)


def _expression(text: str, at: int) -> tuple[list[tuple], list[str]]:
    """The literals of an expression that begins at a place of the text, and the names that it reads. A bare word is either:
    such a literal carries its name."""
    spans, reads = [], []
    for t in _TERM.finditer(text):
        k = t.lastindex
        if k == 1:
            spans.append((at + t.start(1) + 3, at + t.end(1) - 3))
        elif k in (2, 3, 4):
            spans.append((at + t.start(k), at + t.end(k)))
        if k in (1, 2, 4):
            reads += [r[1] for r in _INNER.finditer(t[k])]
        elif k in (5, 6, 7):
            reads.append(t[k])
        if k == 7:
            spans.append((at + t.start(7), at + t.end(7), t[7]))
    return spans, reads


def _markup(m: re.Match) -> list[tuple[str, tuple[int, int]]]:
    """What an element says: attributes that name and value something, and its own text."""
    at, out = m.start("attributes"), []
    found = {a[1].lower(): a.span(2) if a[2] is not None else a.span(3) for a in _ATTRIBUTE.finditer(m["attributes"])}
    named = next((m["attributes"][slice(*found[k])] for k in _NAMING if k in found), None)
    if named and "value" in found:
        out.append((named, (at + found["value"][0], at + found["value"][1])))
    if m["literal"]:
        out.append((named or m["name"], (m.start("literal"), m.start("literal") + len(m["literal"].rstrip()))))
    return out


def statements(text: str) -> list[tuple[int, str, list[tuple], list[str]]]:
    """Where each pair stands, its name, its literals and the names that it reads; in the text's order."""
    found = [(m.start("value"), m["name"], *_expression(m["value"], m.start("value"))) for pattern in _PAIRS for m in pattern.finditer(text)]
    found += [(m.start("literal"), m["name"] or m["scheme"], [m.span("literal")], []) for m in _HEADER.finditer(text)]
    found += [(m.start("body"), m["name"], [(m.start("body") + x.start(), m.start("body") + x.end()) for x in _LINE.finditer(m["body"])], []) for m in _BLOCK.finditer(text)]
    if "<" in text:
        found += [(span[0], name, [span], []) for m in _TAG.finditer(text) for name, span in _markup(m)]
    return sorted(found, key=lambda f: f[0])


def literals(text: str) -> list[tuple[str, int, int, float]]:
    """name, start, end and score of each literal that reaches a name, through other names too: of all names that it
    reaches the most sensitive, and of equal ones the first. A name is looked for in its own section, then before all."""
    marks = [(m.start(), "-" in m[0][:1]) for m in _SECTION.finditer(text)]
    before: dict[str, int] = {}
    last, section = before, 0
    found: list[tuple[str, list[tuple[int, int]], list[int]]] = []  # a statement's name, literals, statements that it reads
    for at, name, spans, names in statements(text):
        while section < len(marks) and marks[section][0] <= at:
            last = {}
            if marks[section][1]:  # another document of the file
                before = last
            section += 1
        known = {n: last.get(n, before.get(n)) for n in names}
        last[name] = len(found)
        found.append((name, [s[:2] for s in spans if len(s) == 2 or known[s[2]] is None], [k for n in names if (k := known[n]) is not None]))
    # a statement reads earlier ones only, so one pass from the last to the first hands each what it reaches
    reached = [(sensitivity(name), -k) for k, (name, _, _) in enumerate(found)]
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for k in range(len(found) - 1, -1, -1):
        own, by = reached[k]
        for j in found[k][2]:
            reached[j] = max(reached[j], reached[k])
        for a, b in found[k][1]:
            if own and (look := strength(text[a:b])) > 0:
                best[a, b] = max(best.get((a, b), (0.0, "")), (0.6 * own + 0.4 * look, found[-by][0]))
    return [(name, a, b, score) for (a, b), (score, name) in best.items()]


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def scan(text: str | None, least: float = 0.75) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans, and all spans: theirs and the lexer's literals that score `least` or more."""
    text = text or ""
    low = text.lower()
    listed = lambda spans: sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    base = base_spans(text, low)
    more = [("literal", a, b) for _, a, b, score in literals(text) if score >= least] if any(h in low for h in _HINTS) else []
    return listed(base), listed(base + more)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _run(batches):
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base, every = scan(text)
            n = Counter(k for k, _, _ in base)
            rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, _ARROW.types)], schema=_ARROW)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind; the digest is that of the patterns'
    spans alone. A null text counts as empty. Whole texts are read, of any length, names of any length and all
    parts of a concatenation. Repeated rows give a row each, other columns are left out, an empty table gives none.
    """
    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
