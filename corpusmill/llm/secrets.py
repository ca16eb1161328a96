"""Problem 4: credentials embedded in source code, configuration and prose.

A keyword automaton reads each text once. Only where it strikes, the expressions of
that keyword's family look at what stands there; values are then validated by
structure (encoded parts decode, armour matches) and freed of placeholders,
references and encrypted values. Every expression is anchored at its strike and what
a line's strikes ask again is remembered, so long lines (minified files) take time in
proportion to their length. Redaction keeps length and alphabet, so that the code
around still parses, and what it writes is no secret any more.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.latest import latest

# Token formats that issuers publish.
ISSUED = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"xapp-[0-9]-[A-Za-z0-9-]{10,}",
    r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"hf_[A-Za-z0-9]{30,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_-]{50,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"dop_v1_[0-9a-f]{64}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}",
]
# What announces such a token, in lower case.
ISSUER_WORDS = ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "xapp-", "_live_", "_test_",
                "sk-", "aiza", "hf_", "npm_", "pypi-", "sg.", "dop_v1_", "eyj"]
# How the name of a secret ends.
NAMES = ["password", "passwd", "passwort", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "api-key", "apikey",
         "access_key", "access-key", "accesskey", "secret_key", "secret-key", "secretkey", "private_key", "private-key",
         "privatekey", "auth_key", "auth-key", "authkey", "encryption_key", "signing_key", "access_key_id", "access-key-id",
         "accesskeyid", "credential", "credentials", "client_key", "account_key", "master_key", "shared_key"]
# Stand-ins and defaults.
DEFAULTS = {"password", "passwd", "pass", "secret", "token", "changeme", "changeit", "change_me", "change-me", "admin", "root", "test",
            "testing", "guest", "user", "username", "default", "example", "sample", "dummy", "placeholder", "none", "null", "nil",
            "undefined", "true", "false", "todo", "tbd", "redacted", "hidden", "masked", "hunter2", "letmein", "qwerty", "secret123",
            "password1", "password123", "admin123", "12345678", "123456789", "1234567890", "postgres", "mysql", "foobar", "mysecret",
            "mypassword", "my-secret", "my_secret", "required", "optional", "string", "value", "key", "api_key", "apikey"}

ISSUED_RX = re.compile("|".join(ISSUED))
ASSIGN_RX = re.compile(r"[\"'`\]]{0,2}\s{0,4}(?::=|=>|==?|:)\s{0,4}(?:[rbuf]{0,2}(?=[\"']))?|(?<=[A-Za-z])[ \t]+(?=\S+\s*$)", re.IGNORECASE)
ENV_RX = re.compile(r"^\s*(?:ENV|ARG|SET|setenv)\s+[A-Za-z0-9_]*(?:" + "|".join(NAMES) + r")\s+[\"']?(?P<raw>[^\s\"']+)", re.IGNORECASE)
BEARER_RX = re.compile(r"\bBearer\s+(?P<raw>[^\s\"'`,;]+)", re.IGNORECASE)
BASIC_RX = re.compile(r"\bBasic\s+(?P<raw>[A-Za-z0-9+/_-]{8,}={0,2})", re.IGNORECASE)
URL_RX = re.compile(r"(?P<user>[^\s:/@\"'`<>]*):(?P<raw>[^\s@/\"'`<>]+)@(?P<host>[^\s/\"'`<>:]*)")
USER_RX = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user)[\s=]+[\"']?(?P<user>[^\s:\"']+):(?P<raw>[^\s\"']+)")
PROSE_RX = re.compile(
    r"\b(?:password|passphrase|passcode|secret|token|api key|access key|secret key)\b[^.\n:=]{0,80}?\b(?:is|was|are|reads)\s+"
    r"(?:\"(?P<dq>[^\"\n]+)\"|'(?P<sq>[^'\n]+)'|`(?P<bq>[^`\n]+)`|(?P<raw>[^\s\"'`]+))", re.IGNORECASE)
ARMOUR_RX = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*)PRIVATE KEY(?P<block> BLOCK)?-----")
REFERENCE_RX = re.compile(
    r"^(?:\$|%[A-Za-z_]+%$|\{\{|<|\[|\(|&|\*{2}|ENC\[|ENC\(|vault:|vault/|secret:|secrets?[./]|ref[:+]|arn:|op://|ssm:|sops:|env[.:(\[]|"
    r"\$ANSIBLE_VAULT|AQICAH|projects/|file:|@)|^[A-Za-z_][\w.]*[(\[]|^(?:process|os|config|settings|env|self|this|secrets|var|local|data|module)\.[A-Za-z_.]+$",
    re.IGNORECASE)
FILLER_INSIDE = (r"\*{4,}|x{6,}|\.{3}|\u2026|your[-_ ]|example|placeholder|change[-_ ]?me|redacted|insert[-_ ]|replace[-_ ]|dummy")
FILLER_RX = re.compile(r"^(.)\1*$|" + FILLER_INSIDE + r"|[-_]here$|^my[-_](?:password|secret|token|key)$|^<.*>$|^\{.*\}$|^\[.*\]$", re.IGNORECASE)
VERSION_RX = re.compile(r"v?\d+(?:\.\d+)*[a-z]?|\d+(?:px|em|ms|s|m|h|d|kb|mb|gb|k)", re.IGNORECASE)
NAMED_RX = re.compile(r"[A-Za-z][a-z]+(?:[A-Z][a-z]+)*(?:[._-]\w+)*")
LONG = 256
# What is asked of a long bare value, by where it next occurs.
ASKED = {
    "stop": re.compile(r"[\s\"'`]"), "filler": re.compile(FILLER_INSIDE, re.IGNORECASE), "letter": re.compile(r"[^\W\d_]"), "digit": re.compile(r"\d"),
    "upper": re.compile(r"[A-Z]"), "lower": re.compile(r"[a-z]"), "mark": re.compile(r"[^\w\-./:]"), "unsafe": re.compile(r"[^A-Za-z0-9_-]"),
    "double": re.compile('"'), "single": re.compile("'"), "back": re.compile("`"),
}
EXAMPLE_HOST = re.compile(r"^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|host|hostname|db|example\.(?:com|org|net))$", re.IGNORECASE)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keyword -> family: what has to be looked at where the keyword strikes."""
    a = ahocorasick.Automaton()
    for word in NAMES:
        a.add_word(word, ("name", len(word)))
    for word in ISSUER_WORDS:
        a.add_word(word, ("issued", len(word)))
    for word, family in (("private key", "armour"), ("bearer", "bearer"), ("basic", "basic"), ("://", "url"), ("-u", "user"),
                         ("--user", "user"), ("api key", "name"), ("access key", "name"), ("secret key", "name")):
        a.add_word(word, (family, len(word)))
    a.make_automaton()
    return a


def weak(value: str) -> bool:
    """A stand-in, default, reference or encrypted value."""
    low = value.lower()
    return (not value or low in DEFAULTS or low.strip("_-<>{}[]()!.") in DEFAULTS or bool(REFERENCE_RX.search(value))
            or bool(FILLER_RX.search(value)))


def literal(value: str, quoted: bool) -> bool:
    """A value that a person or generator chose: not a word, a number or an identifier.

    Shorter than six characters is none: such values are mostly units, flags and words.
    """
    if len(value) < 6 or weak(value) or value.isdigit():
        return False
    if any(ch.isspace() for ch in value):
        return quoted and len(value) >= 12 and any(ch.isdigit() for ch in value) and not value.replace(" ", "").isalpha()
    letters = any(ch.isalpha() for ch in value)
    digits = any(ch.isdigit() for ch in value)
    if letters and digits:
        return not VERSION_RX.fullmatch(value)
    mixed = any(ch.isupper() for ch in value[1:]) and any(ch.islower() for ch in value)
    marks = any(not ch.isalnum() and ch not in "_-./:" for ch in value)
    return letters and (marks or (mixed and len(value) >= 12 and not NAMED_RX.fullmatch(value)))


def decoded(value: str) -> str | None:
    """Base64 (either alphabet, padding optional) as text; None if it isn't."""
    plain = value.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None


def issued_ok(value: str) -> bool:
    """Structure of an issued token: no filler; a JSON web token's header must decode."""
    if FILLER_RX.search(value):
        return False
    if value.startswith("eyJ") and value.count(".") == 2:
        head = decoded(value.split(".")[0])
        try:
            return isinstance(json.loads(head or ""), dict)
        except ValueError:
            return False
    if value.startswith("sk-"):
        return any(ch.isdigit() for ch in value[3:]) or any(ch.isupper() for ch in value[3:])
    return True


def _group(m: re.Match) -> tuple[int, int, bool]:
    for name in ("dq", "sq", "bq", "raw"):
        if name in m.re.groupindex and m.group(name) is not None:
            return *m.span(name), name != "raw"
    raise AssertionError


def _trim(text: str, a: int, b: int, also: str = "") -> int:
    """End of a bare value without the punctuation that follows it in prose or code."""
    opened: dict[str, int] = {}
    while b > a and text[b - 1] in ",;)]}" + also:
        pair = {")": "(", "]": "[", "}": "{"}.get(text[b - 1])
        if pair:
            if pair not in opened:
                opened[pair] = text.find(pair, a, b)
            if 0 <= opened[pair] < b:
                break
        b -= 1
    return b


class Line:
    """A line and where things next occur in it; asked from left to right, every question reads the line once."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, tuple[int, int]] = {}

    def next(self, what: str, at: int) -> int:
        """Place of the first ``what`` at or after ``at``; the line's end if there is none."""
        lo, hi = self.known.get(what, (0, -1))
        if not lo <= at <= hi:
            m = ASKED[what].search(self.text, at)
            lo, hi = at, m.start() if m else len(self.text)
            self.known[what] = (lo, hi)
        return hi

    def literal(self, s: int, e: int, quoted: bool) -> bool:
        """:func:`literal` of text[s:e]; a long bare value is judged without being copied."""
        if e - s <= LONG or quoted:
            return literal(self.text[s:e], quoted)
        t = self.text
        if REFERENCE_RX.match(t, s, e) or self.next("filler", s) < e or t[e - 5 : e].lower() in ("-here", "_here"):
            return False
        if (t[s], t[e - 1]) in (("<", ">"), ("{", "}"), ("[", "]")):
            return False
        letters, digits = self.next("letter", s) < e, self.next("digit", s) < e
        if letters and digits:
            return not VERSION_RX.fullmatch(t, s, e)
        marks = self.next("mark", s) < e
        mixed = self.next("upper", s + 1) < e and self.next("lower", s) < e
        return letters and (marks or (mixed and not NAMED_RX.fullmatch(t, s, e)))

    def value(self, s: int) -> tuple[int, int, bool] | None:
        """(start, end, quoted) of the value that begins at ``s``: up to the closing quote, or bare up to white space or a quote."""
        mark = self.text[s : s + 1]
        if mark in ("\"", "'", "`") and mark:
            e = self.next({"\"": "double", "'": "single", "`": "back"}[mark], s + 1)
            return (s + 1, e, True) if e < len(self.text) else None
        e = self.next("stop", s)
        return (s, e, False) if e > s else None


def _assigned(line: Line, ends: list[int]) -> Iterator[tuple[int, int]]:
    """Values assigned to names of secrets that end at ``ends``."""
    text = line.text
    for end in ends:
        m = ASSIGN_RX.match(text, end)
        found = line.value(m.end()) if m else None
        if not found:
            continue
        s, e, quoted = found
        before = s - 1
        while before >= 0 and text[before].isspace():
            before -= 1
        if not quoted and text[before] != ":":
            e = _trim(text, s, e)
        if e > s and not (e - s < 7 and text[s:e].lower() in ("bearer", "basic")) and line.literal(s, e, quoted):
            yield s, e


def _named(line: str) -> Iterator[tuple[int, int]]:
    """Values that a build file's instruction or a sentence gives."""
    for rx in (ENV_RX, PROSE_RX):
        at = 0
        while m := rx.search(line, at):
            s, e, quoted = _group(m)
            at = max(m.start() + 1, s)
            if not quoted:
                e = _trim(line, s, e, "." if rx is PROSE_RX else "")
            value = line[s:e]
            if rx is PROSE_RX and not (any(ch.isdigit() for ch in value) and len(value) >= 8):
                continue
            if literal(value, quoted):
                yield s, e


def _issued(line: Line, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Issuers' tokens that begin at ``starts``."""
    text, after = line.text, 0
    for s in starts:
        if s < after or (s and text[s - 1].isascii() and text[s - 1].isalnum()):
            continue
        if text.startswith("eyJ", s) and text[line.next("unsafe", s) :][:1] != ".":
            continue
        if m := ISSUED_RX.match(text, s):
            after = m.end()
            if issued_ok(m.group()):
                yield m.span()


def _in_line(text: str, a: int, b: int, strikes: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """Spans of secrets in text[a:b], one line; strikes: family -> places in the line (ends of names, starts of others)."""
    line = text[a:b]
    seen = Line(line)
    spans: list[tuple[int, int]] = []
    if "issued" in strikes:
        spans += _issued(seen, sorted(set(strikes["issued"])))
    for p in strikes.get("url", ()):
        scheme = p
        while scheme and (line[scheme - 1].isdigit() or line[scheme - 1] in "+.-"):
            scheme -= 1
        m = URL_RX.match(line, p + 3) if scheme and line[scheme - 1].isascii() and line[scheme - 1].isalpha() else None
        if m:
            value = m.group("raw")
            if not weak(value) and not (EXAMPLE_HOST.match(m.group("host")) and not literal(value, True)):
                spans.append(m.span("raw"))
    if "user" in strikes:
        spans += [m.span("raw") for m in USER_RX.finditer(line) if len(m.group("raw")) >= 6 and not weak(m.group("raw"))]
    if "bearer" in strikes:
        for m in BEARER_RX.finditer(line):
            e = _trim(line, *m.span("raw"), ".")
            value = line[m.start("raw"):e]
            if len(value) >= 12 and literal(value, False):
                spans.append((m.start("raw"), e))
    if "basic" in strikes:
        for m in BASIC_RX.finditer(line):
            plain = decoded(m.group("raw"))
            if plain and ":" in plain and plain.isprintable() and not weak(plain.split(":", 1)[1]):
                spans.append(m.span("raw"))
    if "name" in strikes:
        spans += _assigned(seen, sorted(set(strikes["name"])))
        spans += _named(line)
    return ((a + s, a + e) for s, e in spans)


def _keys(text: str) -> list[tuple[int, int]]:
    """Private keys from the first to the last dash of their armour; encrypted and redacted ones are none."""
    out, ends, at = [], {}, 0
    while m := ARMOUR_RX.search(text, at):
        at = m.end()
        tail = f"-----END {m.group('kind')}PRIVATE KEY{m.group('block') or ''}-----"
        if ends.get(tail, 0) < at:
            ends[tail] = text.find(tail, at)
            if ends[tail] < 0:
                ends[tail] = len(text) + 1
        end = ends[tail]
        if end > len(text):
            continue
        body = text[at:end]
        if "ENCRYPTED" not in m.group("kind") and "4,ENCRYPTED" not in body[:200] and len(set("".join(body.split()))) > 1:
            out.append((m.start(), end + len(tail)))
        at = end + len(tail)
    return out


def find(text: str | None) -> list[tuple[int, int]]:
    """All spans (start, end) of secrets in a text, in order, none inside another."""
    if not text:
        return []
    lines: list[tuple[int, int, dict[str, list[int]]]] = []
    armour = False
    low = text.lower()
    if len(low) != len(text):  # a few letters get longer; fold only ASCII then
        low = "".join(ch.lower() if ch < "\x80" else ch for ch in text)
    a, b = 0, -1
    for end, (family, size) in automaton().iter(low):
        if family == "armour":
            armour = True
            continue
        if end >= b:
            a = text.rfind("\n", max(b, 0), end + 1) + 1 or a
            b = text.find("\n", end + 1)
            b = len(text) if b < 0 else b
            lines.append((a, b, {}))
        place = end + 1 - a
        if family == "issued" and low[end - size + 1] == "_":  # the two letters before belong to it
            size += 2
        lines[-1][2].setdefault(family, []).append(place if family == "name" else max(0, place - size))
    blocks = _keys(text) if armour else []
    spans = list(blocks)
    starts = [s for s, _ in blocks]
    for a, b, strikes in lines:
        i = bisect_right(starts, a) - 1
        if i < 0 or b > blocks[i][1]:
            spans += _in_line(text, a, b, strikes)
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            continue
        out.append((s, e))
    return out


def placeholder(value: str) -> str:
    """Same length, an alphabet the value's own holds: zeros for digits and hex, else one letter.

    Nothing that :func:`find` would report again. Of a private key's armour the
    dashes, the labels and the line ends stay.
    """
    if value.startswith("-----BEGIN"):
        head, tail = value.index("-----", 10) + 5, value.rindex("-----END")
        return value[:head] + re.sub(r"\S", "x", value[head:tail]) + value[tail:]
    letters = [ch for ch in value if ch.isalpha()]
    if all(ch in "0123456789abcdefABCDEF" for ch in value if ch.isalnum()):
        mark = "0"
    else:
        mark = "X" if all(ch.isupper() for ch in letters) else "x"
    return mark * len(value)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every span replaced; everything else stays in place."""
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], placeholder(text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str, text: str, at: str | None = None, redacted: bool = False) -> DataFrame:
    """(key, spans, redacted text) of every record that holds secrets.

    df: one row per key, or several states of which the latest by ``at`` counts.
    spans: array of (start_pos, end_pos) in code points, end exclusive. The
        redacted text comes only if asked for. Null and empty texts hold none;
        null keys are dropped. Every text is read whole, once, where it lies;
        what is shuffled to find the latest state is the key and its findings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [find(t) for t in texts]
            rows = [[{"start_pos": s, "end_pos": e} for s, e in x] or None for x in spans]
            clean = [redact(t, x) if x and redacted else None for t, x in zip(texts, spans)]
            kind = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, kind), pa.array(clean, pa.string())],
                names=[*batch.schema.names[:-1], "spans", "redacted"])

    keep = [key, *([at] if at else [])]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    found = df.filter(F.col(key).isNotNull()).select(*keep, text).mapInArrow(
        run, f"{schema}, spans array<struct<start_pos:bigint,end_pos:bigint>>, redacted string")
    if at:
        found = latest(found, key, at, ["spans", "redacted"])
    return found.filter("spans IS NOT NULL").select(key, "spans", "redacted")
