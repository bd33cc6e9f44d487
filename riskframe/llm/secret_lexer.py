"""Secret scans: fixed patterns, and literals that flow to sensitive names in source and configuration text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.texts import map_texts

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Kinds of spans in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "flow")

#: What stands for a secret in a redacted text.
MARK = "[REDACTED]"

# The forms of string literals, longest first; each has its content as a group.
STRINGS = (
    r'"""((?:[^"\\]|\\.|"(?!""))*)"""', r"'''((?:[^'\\]|\\.|'(?!''))*)'''",
    r'"((?:[^"\\\n]|\\.)*)"', r"'((?:[^'\\\n]|\\.)*)'", r"`((?:[^`\\\n]|\\.)*)`",
)
#: Letters before a quote that belong to the string.
PREFIX = r"[fFrRbBuU]{0,2}"
#: A quote after a letter or a backslash opens no string: it is an apostrophe or escaped.
LEXEME = re.compile(
    rf"""(?<![\w\\]){PREFIX}(?:{"|".join(STRINGS)})|(?P<op>(?<![=:!<>+*/%&|^~-])(?::=|=>|=(?![=~])|:(?![:/])))"""
    r"""|(?P<name>[A-Za-z_$][\w$.-]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n)""",
    re.ASCII,
)
NAME_LIKE = re.compile(r"[A-Za-z_$][\w$.-]*", re.ASCII)
#: What may lie between a target and its operator, and between both operators of a typed assignment.
GAP = re.compile(r"""["'`]?\]?[ \t]*""")
TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.\[\], |]*[ \t]*", re.ASCII)
VALUE = re.compile(
    rf"[ \t]*(?:{PREFIX}(?:{'|'.join(STRINGS)})" r"""|([A-Za-z_$][\w$.-]*(?![\w$(.+/=-]))|([^\s"'`,;#()\[\]{}]+))""", re.ASCII
)
IS_NAME = len(STRINGS) + 1
#: A string on the line after its operator, unless it is a key itself; and the second argument of a call, its default.
BELOW = re.compile(r"""[ \t]*\\?\r?\n[ \t]*(?=["'`])""")
KEY_AFTER = re.compile(r"[ \t]*[:=]")
DEFAULT = re.compile(r"""[ \t]*[A-Za-z_$][\w$.]*\(\s*["'][^"'\n]*["']\s*,\s*(?=["'`])""", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>]+)</\1>", re.ASCII)
JOINED = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]))[ \t]*(?=[\"'`A-Za-z_$])")

# Parts of names and how surely what they name is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "token": 0.9, "pass": 0.7, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5,
}
KEYED = {"api", "access", "private", "secret", "auth", "signing", "encryption", "master", "account", "storage", "service"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|sample|test|none|null|true|false|todo|your\b.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")

#: Score from which a literal counts as a secret.
THRESHOLD = 0.5


def name_score(name: str) -> float:
    """How sensitive a target's name is, from 0 to 1."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name.replace("-", " ").replace("_", " ").replace(".", " ").replace("$", " "))
    parts = spaced.lower().split()
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(p in ("key", "keys") for p in parts) and KEYED & set(parts):
        best = 1.0
    return best


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, from 0 to 1: length, entropy, and for bare words a mix of characters."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * log2(c / n) for c in Counter(value).values())
    score = min(1.0, n / 12) * min(1.0, entropy / 3.0)
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not quoted and (kinds < 2 or not re.search("[0-9]", value)):
        return 0.0
    if re.search(r"\s", value.strip()):  # a sentence
        score *= 0.4
    return score if kinds > 1 else score * 0.6


def _parts(text: str, end: int) -> list[tuple[str, int, int, bool]]:
    """The value after an operator that ends at ``end``: strings, names and bare words that are joined."""
    if default := DEFAULT.match(text, end):
        end = default.end()
    elif below := BELOW.match(text, end):
        first = VALUE.match(text, below.end())
        if not first or KEY_AFTER.match(text, first.end()):
            return []
        end = below.end()
    parts = []
    while part := VALUE.match(text, end):
        which = part.lastindex
        parts.append(("name" if which == IS_NAME else "literal", *part.span(which), which < IS_NAME))
        more = JOINED.match(text, part.end())
        if not more:
            break
        end = more.end()
    return parts


def statements(text: str) -> list[tuple[int, str, list[tuple[str, int, int, bool]]]]:
    """Position, target name and value parts of each assignment; a part is (kind, start, end, quoted), kind "literal" or "name".

    The text is read once, lexeme by lexeme. Operators inside strings assign nothing. ``name: Type = value`` assigns to ``name``;
    ``(name: Type)`` assigns nothing. A value may be on the next line, be a call's default or an element's content.
    """
    found = []
    target, typed, brackets = None, None, []
    for lexeme in LEXEME.finditer(text):
        kind = lexeme.lastgroup
        if kind == "op":
            at, end, sign = lexeme.start(), lexeme.end(), lexeme["op"]
            name = target[0] if target and GAP.fullmatch(text, target[1], at) else None
            if sign == "=" and typed and TYPE.fullmatch(text, typed[1], at):
                name = typed[0]
                if found and found[-1][0] == typed[2]:
                    found.pop()  # that was the type
            typed = (name, end, at) if sign == ":" and name else None
            if name and (parts := _parts(text, end)):
                bare = all(p[0] == "name" for p in parts)
                if not (sign == ":" and bare and brackets and brackets[-1] == "("):
                    found.append((at, name, parts))
        elif kind == "name":
            target = (lexeme[0], lexeme.end())
        elif kind == "line":
            target = typed = None
        elif kind == "open":
            brackets.append(lexeme[0])
        elif kind == "close":
            if brackets:
                brackets.pop()
        else:
            inside = lexeme[lexeme.lastindex]
            target = (inside, lexeme.end()) if NAME_LIKE.fullmatch(inside) else None
    for element in ELEMENT.finditer(text) if "</" in text else ():
        found.append((element.start(), element[1], [("literal", *element.span(2), False)]))
    return sorted(found, key=lambda f: f[0])


def flows(text: str) -> list[tuple[int, int]]:
    """Places of the literals that reach a sensitive name, directly or through constants, and score as secrets."""
    found = statements(text)
    if not found:
        return []
    defined: dict[str, list[int]] = defaultdict(list)
    for i, (_, name, _) in enumerate(found):
        defined[name].append(i)
    # From the most sensitive targets on, each assignment is reached once: linear in the text.
    reached: dict[int, float] = {}
    order = sorted(((name_score(name), i) for i, (_, name, _) in enumerate(found)), key=lambda x: (-x[0], x[1]))
    for score, first in order:
        if score <= 0:
            break
        waiting = [first]
        while waiting:
            i = waiting.pop()
            if i in reached:
                continue
            reached[i] = score
            for kind, start, end, _ in found[i][2]:
                places = defined.get(text[start:end]) if kind == "name" else None
                if places:  # the last definition before the use, else the first after it
                    before = bisect_left(places, i)
                    waiting.append(places[max(0, before - 1)])
    spans = set()
    for i, score in reached.items():
        literals = [p for p in found[i][2] if p[0] == "literal" and p[2] > p[1]]
        value = "".join(text[start:end] for _, start, end, _ in literals)
        quoted = any(p[3] for p in literals)
        named = [p for p in found[i][2] if p[0] == "name"]
        if literals and score * literal_score(value, quoted) >= THRESHOLD:
            spans.update((start, end) for _, start, end, _ in literals)
        elif not literals and len(named) == 1 and not defined.get(text[named[0][1] : named[0][2]]):
            # A bare word that names nothing is a configuration value.
            start, end = named[0][1:3]
            if score * literal_score(text[start:end], False) >= THRESHOLD:
                spans.add((start, end))
    return sorted(spans)


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of all spans, by start and kind. Base kinds, and "flow" outside them."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        spans.sort(key=lambda s: s[1])
        covered, least = [], 0
        for _, start, end, _ in spans:
            least = max(least, end)
            covered.append((start, least))
        for start, end in flows(text):
            i = bisect_left(covered, (start + 1,)) - 1
            if i < 0 or covered[i][1] < end:
                spans.append(("flow", start, end, start))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id`` and its ``spans``: kind, start and end in code points (end exclusive), by start, then kind.

    NULL and empty texts have none. A row for each row, repeated ones too; texts have no longest length, and other columns are not
    read. No rows give no rows.
    """

    def start():
        return lambda text: ([{"kind": k, "start": s, "end": e} for k, s, e, _ in scan(text)],)

    return map_texts(documents, "text", ["doc_id"], "spans array<struct<kind: string, start: bigint, end: bigint>>", start)


def redacted(text: str) -> str:
    """The text with a mark in place of each secret; overlapping ones become one mark."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in scan(text)):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(documents: DataFrame) -> DataFrame:
    """The same rows with secrets marked out of ``text``, and ``n_chars`` (if there is such a column) counted anew where that changed it.

    A NULL text stays NULL.
    """
    columns = documents.columns
    marked = F.struct(F.col("text").isNull().alias("none"), F.struct(*[F.col(c) for c in columns if c != "text"]).alias("rest"))
    rows = documents.select("text", marked.alias("kept"))
    rows = map_texts(rows, "text", ["kept"], "redacted string, changed boolean", lambda: lambda text: ((new := redacted(text)), new != text))
    new = F.when(F.col("kept.none"), F.lit(None).cast("string")).otherwise(F.col("redacted"))

    def column(name: str):
        if name == "text":
            return new.alias("text")
        old = F.col("kept.rest").getField(name)
        if name == "n_chars":
            old = F.when(F.col("changed"), F.length("redacted").cast(documents.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return rows.select(*[column(c) for c in columns])
