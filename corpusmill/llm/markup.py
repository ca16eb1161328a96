"""Problem 7: markup residue in text documents.

A document is parsed into leaves, each with its root-to-leaf tag path (Markdown
blocks, HTML elements, wiki and LaTeX constructs) and its kind of residue. Text
length and punctuation are aggregated per tag path over the corpus, smoothed
along the path tree, fused into one score and thresholded: paths that carry text
are content, the rest is furniture. The clean text keeps headings, lists, code
blocks and formulas, unwraps content and drops furniture.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.latest import latest
from corpusmill.runtime import materialise, small_rows

KINDS = ("html", "wiki", "latex")
DEPTH = 32  # a deeper element's path is that of its nearest ancestors

# The elements of HTML.
ELEMENTS = set("""a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas
caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math
menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search
section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr
track tt u ul var video wbr""".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# Elements that a start tag closes, if one is open and was never closed.
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
# Elements whose text is never content, and LaTeX commands whose argument is a name, not text.
SILENT = {"script", "style", "head", "template", "noscript"}
NAMES = {"label", "ref", "cite", "citep", "citet", "eqref", "pageref", "usepackage", "documentclass", "includegraphics", "input", "include",
         "bibliography", "bibliographystyle", "vspace", "hspace", "begin", "end", "href"}
HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
MATH = {"equation", "align", "gather", "multline", "eqnarray", "math", "displaymath", "flalign", "alignat"}

FENCE = re.compile(r"^[^\S\n]*(?:[-*+>][^\S\n]+|\d+[.)][^\S\n]+)*(`{3,}(?=[^`\n]*$)|~{3,})", re.MULTILINE)
TICKS = re.compile(r"`+")
TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<rest>(?:\s+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?\s*/?)>")
DOCTYPE = re.compile(r"<!DOCTYPE[^>]*>", re.IGNORECASE)
AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.\-]+:[^\s<>]*>|<[^\s<>@]+@[^\s<>]+>|(?:https?|ftp)://[^\s<>)\]]+")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WIKI_LINK = re.compile(r"\[\[(?P<body>[^\[\]\n]+)\]\]")
TEMPLATE = re.compile(r"\{\{(?P<body>[^{}]+)\}\}")
WIKI_HEAD = re.compile(r"^[ \t]*(?P<eq>={2,6})[ \t]*(?P<body>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*(?P=eq)[ \t]*\r?$", re.MULTILINE)
WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*(?:\n.*?)?(?:^[ \t]*\|\}|\Z)", re.MULTILINE | re.DOTALL)
EMPHASIS = re.compile(r"(?<![\w'])(?P<q>'{2,3}|'{5})(?![\s',.)\]])(?P<body>(?:[^'\n]|'(?!'))*?)(?<![\s'(\[,])(?P=q)(?![\w'])")
COMMAND = re.compile(r"\\(?P<name>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{(?P<body>[^{}]*)\}")
COMMAND_OPEN = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")
ENVIRONMENT = re.compile(r"\\(?P<what>begin|end)\{(?P<name>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*")
DISPLAY = re.compile(r"(?<![\\$])\$\$(?!\$)(?P<body>(?:[^$\n]|\n(?![ \t]*\n)|\\\$)+?)\$\$(?!\$)")
DOLLAR = re.compile(r"(?<![\\$\w])\$(?P<body>[^\s$`](?:(?:[^$`\n\\]|\\.)*?[^\s$`\\])?)\$(?![\w$])")
PAREN = (re.compile(r"(?<!\\)\\\("), re.compile(r"(?<!\\)\\\)"))
BRACKET = (re.compile(r"(?<!\\)\\\["), re.compile(r"(?<!\\)\\\]"))
BLANK_LINE = re.compile(r"\n(?=[ \t]*\n)")
BRACES = re.compile(r"\\(?P<name>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{|[{}]")
BLOCKS = (
    ("h", re.compile(r"[ \t]{0,3}#{1,6}(?:\s|$)")), ("li", re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s")),
    ("td", re.compile(r"\s*\|")), ("quote", re.compile(r"\s{0,3}>")),
)


@dataclass
class Leaf:
    """A construct of the document: where it stands, its tag path and what kind of residue it is."""

    start: int
    end: int
    path: tuple[str, ...]
    kind: str = ""
    text: str = ""


def comments(text: str) -> list[tuple[int, int]]:
    """Spans of HTML comments and document types; of a comment that is never closed in the last line, its opening."""
    out, at = [], 0
    last_close, last_line = text.rfind("-->"), text.rfind("\n", 0, max(0, len(text) - 1)) + 1
    while (s := text.find("<!--", at)) >= 0:
        at = s + 4
        if last_close >= at:
            at = text.find("-->", at) + 3
            out.append((s, at))
        elif s >= last_line:
            out.append((s, at))
    inside = [s for s, _ in out]
    for m in DOCTYPE.finditer(text) if "<!" in text else ():
        i = bisect_right(inside, m.start()) - 1
        if i < 0 or m.start() >= out[i][1]:
            out.append(m.span())
    return sorted(out)


def paired(text: str, marks: tuple[re.Pattern, re.Pattern]) -> list[tuple[int, int]]:
    """Spans from an opening mark to the next closing one in the same paragraph, each mark looked at once."""
    opens = [m.start() for m in marks[0].finditer(text)]
    if not opens:
        return []
    closes, blanks = [m.start() for m in marks[1].finditer(text)], [m.start() for m in BLANK_LINE.finditer(text)]
    out, end = [], 0
    for s in opens:
        if s < end:
            continue
        c, b = bisect_left(closes, s + 3), bisect_left(blanks, s)
        if c < len(closes) and (b == len(blanks) or blanks[b] > closes[c]):
            end = closes[c] + 2
            out.append((s, end))
    return out


def _swap(text: str, spans: list[tuple[int, int]], by) -> str:
    """The text with each span replaced by what ``by`` makes of it."""
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], by(text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def unwrap_commands(text: str, by) -> str:
    """Commands with a braced argument replaced by ``by(name, argument)``, inner ones first, in one pass.

    An argument with braces of its own, and a brace that is never closed, leave their command as it is.
    """
    stack: list[tuple[str, str | None, list[str]]] = []
    top: list[str] = []
    at = 0
    for m in BRACES.finditer(text):
        top.append(text[at : m.start()])
        at = m.end()
        if m.group() != "}":
            stack.append((m.group(), m.group("name"), top))
            top = []
        elif stack:
            opening, name, outer = stack.pop()
            body = "".join(top)
            plain = name is not None and "{" not in body and "}" not in body
            outer.append(by(name, body) if plain else opening + body + "}")
            top = outer
        else:
            top.append("}")
    top.append(text[at:])
    return "".join([piece for opening, _, outer in stack for piece in (*outer, opening)] + top)


def code_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, fenced) of fenced blocks (to the end if never closed) and inline code."""
    out: list[tuple[int, int, bool]] = []
    if "`" not in text and "~~~" not in text:
        return out
    at = 0
    while m := FENCE.search(text, at):
        mark = m.group(1)
        close = re.compile(rf"^(?:[^\S\n]|>)*{re.escape(mark[0])}{{{len(mark)},}}[^\S\n]*$", re.MULTILINE)
        line_end = text.find("\n", m.end())
        c = close.search(text, line_end + 1) if line_end >= 0 else None
        start = text.rfind("\n", 0, m.start(1)) + 1
        at = c.end() if c else len(text)
        out.append((start, at, True))
    edges = [0, *[x for s, e, _ in out for x in (s, e)], len(text)]
    for a, b in zip(edges[::2], edges[1::2]):
        pos = a
        while pos < b and (m := TICKS.search(text, pos, b)):
            run, pos = m.group(), m.end()
            blank = re.compile(r"\n[ \t\r]*\n").search(text, pos, b)
            stop = blank.start() if blank else b
            for c in TICKS.finditer(text, pos, stop):
                if c.group() == run:
                    out.append((m.start(), c.end(), False))
                    pos = c.end()
                    break
    return sorted(out)


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans replaced by NULs (line ends stay), all positions unchanged."""
    out, at = [], 0
    for s, e in spans:
        if s < at:
            continue
        piece = text[s:e]
        out += [text[at:s], "\0" * len(piece) if "\n" not in piece else re.sub(r"[^\n]", "\0", piece)]
        at = e
    return "".join([*out, text[at:]])


def _is_tag(m: re.Match, text: str) -> bool:
    name = m.group("name")
    if name.lower() not in ELEMENTS:
        return False
    before = text[m.start() - 1 : m.start()]
    camel = name[:1].isupper() and (len(name) == 1 or not name.isupper())
    if not m.group("close") and not m.group("rest").strip() and camel and (before.isalnum() or before in "_."):
        return False  # a generic type such as List<Button>
    return True


def _is_formula(body: str) -> bool:
    """Content of $...$: not a stretch of prose between two prices."""
    if body[0].isdigit() and not re.search(r"[\\^_=+*/<>{}]", body):
        return bool(re.fullmatch(r"[\d.,]+[A-Za-z]?", body))
    return not re.search(r"[A-Za-z]{2,}\s+[A-Za-z]{2,}\s+[A-Za-z]{2,}", re.sub(r"\\[A-Za-z]+(?:\{[^{}]*\})?", "", body))


def residue(text: str, code: list[tuple[int, int, bool]]) -> list[Leaf]:
    """All constructs of HTML, wiki and LaTeX outside code."""
    if not any(x in text for x in "<&[{='\\$"):
        return []
    plain = blanked(text, [(s, e) for s, e, _ in code])
    out: list[Leaf] = []
    if "\\" in plain or "$" in plain:
        for marks, name in ((BRACKET, "display"), (PAREN, "inline")):
            out += [Leaf(a, b, ("latex", name), "latex", plain[a + 2 : b - 2]) for a, b in paired(plain, marks) if plain[a + 2 : b - 2].strip("\0 \n")]
        for rx, name in ((DISPLAY, "display"), (DOLLAR, "inline")):
            for m in rx.finditer(plain):
                if m.group("body").strip("\0 \n") and (rx is not DOLLAR or _is_formula(m.group("body"))):
                    out.append(Leaf(*m.span(), ("latex", name), "latex", m.group("body")))
        for m in COMMAND_OPEN.finditer(plain):
            full = COMMAND.match(plain, m.start()) or m
            name = re.match(r"\\([A-Za-z]+)", full.group()).group(1)
            body = full.group("body") if full.re is COMMAND else ""
            out.append(Leaf(*full.span(), ("latex", name), "latex", body))
    if "[[" in plain:
        for m in WIKI_LINK.finditer(plain):
            body = m.group("body")
            if re.search(r"[^\W\d_]", body) and body[:1] not in " -!$" and not re.search(r"[\"'=]", body):
                out.append(Leaf(*m.span(), ("wiki", "link"), "wiki", body.rsplit("|", 1)[-1]))
    if "{{" in plain:
        out += [Leaf(*m.span(), ("wiki", "template"), "wiki", m.group("body")) for m in TEMPLATE.finditer(plain)]
    if "{|" in plain:
        out += [Leaf(*m.span(), ("wiki", "table"), "wiki", m.group()) for m in WIKI_TABLE.finditer(plain)]
    if "==" in plain:
        out += [Leaf(*m.span(), ("wiki", f"h{len(m.group('eq'))}"), "wiki", m.group("body")) for m in WIKI_HEAD.finditer(plain)]
    if "''" in plain:
        out += [Leaf(*m.span(), ("wiki", "emphasis"), "wiki", m.group("body")) for m in EMPHASIS.finditer(plain)]
    if "<" in plain or "&" in plain:
        if "://" in plain or "@" in plain:
            links = [m.span() for m in AUTOLINK.finditer(plain) if not (plain[m.start()] == "<" and TAG.match(plain, m.start()))]
            marked = blanked(plain, links)
        else:
            marked = plain
        # A link inside an attribute must not hide its tag, so tags are read from the plain text.
        taken = comments(plain)
        out += [Leaf(a, b, ("html", "comment"), "html") for a, b in taken]
        starts = [a for a, _ in taken]
        commented = lambda at: (i := bisect_right(starts, at) - 1) >= 0 and at < taken[i][1]
        tags = [m for m in TAG.finditer(plain) if _is_tag(m, plain) and not commented(m.start())]
        stack: list[str] = []
        for i, m in enumerate(tags):
            name = m.group("name").lower()
            if i and "\n\n" in plain[tags[i - 1].end() : m.start()]:  # inline elements end with their paragraph
                stack = [t for t in stack if t not in INLINE]
            if m.group("close"):
                while stack and name in stack and stack.pop() != name:
                    pass
            until = tags[i + 1].start() if i + 1 < len(tags) else m.end()
            if name in VOID or m.group("rest").rstrip().endswith("/"):
                out.append(Leaf(*m.span(), ("html", *stack[-DEPTH + 2 :], name), "html"))
            else:
                if not m.group("close"):
                    if stack and stack[-1] in CLOSED_BY.get(name, ()):
                        stack.pop()
                    stack.append(name)
                inside = plain[m.end() : until] if stack else ""
                out.append(Leaf(*m.span(), ("html", *stack[-DEPTH + 1 :]) if stack else ("html", name), "html", inside))
        for m in ENTITY.finditer(marked):
            if m.group()[1] == "#" or m.group()[1:] in html5:
                out.append(Leaf(*m.span(), ("html", "entity"), "html"))
    return out


def leaves(text: str | None) -> list[Leaf]:
    """Residue, code blocks and Markdown blocks of a document, each with its tag path."""
    if not text:
        return []
    code = code_spans(text)
    out = residue(text, code)
    fences = [(s, e) for s, e, fenced in code if fenced]
    out += [Leaf(s, e, ("md", "code"), "", text[s:e]) for s, e in fences]
    at = 0
    for line in blanked(text, fences).split("\n"):
        if line.strip("\0 \t\r"):
            tag = next((t for t, rx in BLOCKS if rx.match(line)), "p")
            out.append(Leaf(at, at + len(line), ("md", tag), "", line))
        at += len(line) + 1
    return out


def kinds(text: str | None) -> list[str]:
    """The kinds of residue in a document."""
    if not text:
        return []
    found = {leaf.kind for leaf in residue(text, code_spans(text))}
    return [k for k in KINDS if k in found]


def found_kinds(df: DataFrame, key: str, text: str, at: str | None = None) -> DataFrame:
    """(key, kind): one row for each kind of residue a document holds.

    df: one row per key, or several states of which the latest by ``at`` counts.
    Null and empty texts hold none; null keys are dropped. Texts are parsed whole
    where they lie; only keys and kinds are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kinds(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.string()))],
                                             names=[*batch.schema.names[:-1], "kinds"])

    keep = [key, *([at] if at else [])]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    parsed = df.filter(F.col(key).isNotNull()).select(*keep, text).mapInArrow(run, f"{schema}, kinds array<string>")
    if at:
        parsed = latest(parsed, key, at, ["kinds"])
    return parsed.select(key, F.explode("kinds").alias("kind")).distinct()


PUNCTUATION = re.compile(r"[.,;:!?\u2026\u3002\uff0c]")


def path_ratios(df: DataFrame, text: str) -> DataFrame:
    """(path, nodes, chars, chars2, marks): text and punctuation per tag path, over all documents.

    Each task sums its own paths first; what is shuffled is a row per task and path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[float]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for leaf in leaves(t):
                    body = leaf.text.strip("\0 \t\r\n")
                    row = total.setdefault("/".join(leaf.path[:DEPTH]), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += len(body)
                    row[2] += len(body) ** 2
                    row[3] += len(PUNCTUATION.findall(body))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), *[pa.array([r[i] for r in total.values()], pa.float64()) for i in range(4)]],
            names=["path", "nodes", "chars", "chars2", "marks"])

    local = df.select(text).mapInArrow(run, "path string, nodes double, chars double, chars2 double, marks double")
    return local.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("nodes", "chars", "chars2", "marks")])


def score_paths(ratios: DataFrame, smoothing: float = 20.0, strictness: float = 0.5) -> DataFrame:
    """(path, score, content): the fused tag-path ratio of each path and the verdict.

    The text ratio (characters a node) and the punctuation ratio (marks a node)
    of a path are smoothed towards its parent's as if it had ``smoothing`` nodes
    more, fused as log(1+text) * (1+log(1+marks)), and compared with the
    node-weighted mean less ``strictness`` standard deviations.
    """
    rows = ratios.withColumn("parent", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")))
    up = rows.groupBy("parent").agg(*[F.sum(c).alias("p_" + c) for c in ("nodes", "chars", "marks")])
    both = rows.join(up, "parent")
    smooth = lambda c: (F.col(c) + smoothing * F.col("p_" + c) / F.col("p_nodes")) / (F.col("nodes") + smoothing)
    scored = both.withColumn("score", F.log1p(smooth("chars")) * (1 + F.log1p(smooth("marks"))))
    total = scored.agg((F.sum(F.col("score") * F.col("nodes")) / F.sum("nodes")).alias("mean"),
                       (F.sum(F.col("score") ** 2 * F.col("nodes")) / F.sum("nodes")).alias("square"))
    cut = F.col("mean") - strictness * F.sqrt(F.greatest(F.col("square") - F.col("mean") ** 2, F.lit(0.0)))
    return scored.crossJoin(F.broadcast(total)).select("path", "nodes", "score", (F.col("score") >= cut).alias("content"))


def _template(body: str) -> str:
    """What a wiki template says: its unnamed arguments; a box of named fields says nothing."""
    return " ".join(p.strip() for p in body.split("|")[1:] if "=" not in p and p.strip())


def _table(body: str) -> str:
    """Rows of a wiki table as lines with cells between bars."""
    rows: list[list[str]] = [[]]
    for line in body.split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|}", "|+")) or not line:
            continue
        if line.startswith("|-"):
            rows.append([])
        elif line[0] in "|!":
            rows[-1] += [c.rsplit("|", 1)[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows if r)


def _settled(rx: re.Pattern, by, x: str) -> str:
    """Replace until nothing is left to replace; every replacement takes marks away, so that comes."""
    n = 1
    while n:
        x, n = rx.subn(by, x)
    return x


def clean(text: str | None, furniture: frozenset[str] = frozenset()) -> str | None:
    """The text without residue, with headings, lists, code blocks and formulas.

    furniture: tag paths ("html/div/...") whose text is dropped. Code stays as it
    is, formulas keep their dollar signs. Nested constructs are unwrapped to any
    depth. Null stays null.
    """
    if not text:
        return text
    code = code_spans(text)
    held: list[str] = []

    def hold(piece: str) -> str:
        held.append(piece)
        return f"\x01{len(held) - 1}\x02"

    out, at = [], 0
    for s, e, _ in code:
        if s < at:
            continue
        out += [text[at:s].replace("\x01", "").replace("\x02", ""), hold(text[s:e])]
        at = e
    x = "".join([*out, text[at:].replace("\x01", "").replace("\x02", "")])
    x = _swap(x, comments(x), lambda m: "")
    x = DISPLAY.sub(lambda m: hold(m.group()), x)
    x = _swap(x, paired(x, BRACKET), lambda m: hold("$$" + m[2:-2] + "$$"))
    x = _swap(x, paired(x, PAREN), lambda m: hold("$" + m[2:-2].strip() + "$"))
    x = re.sub(r"\\begin\{(" + "|".join(sorted(MATH)) + r")(\*?)\}(.*?)\\end\{\1\2\}", lambda m: hold("$$" + m.group(3).strip() + "$$"), x, flags=re.DOTALL)
    x = DOLLAR.sub(lambda m: hold(m.group()) if _is_formula(m.group("body")) else m.group(), x)
    x = ENVIRONMENT.sub("", x)
    x = re.sub(r"^[ \t]*\\item\b[ \t]*(?:\[[^\]\n]*\])?[ \t]*", "- ", x, flags=re.MULTILINE)
    said = lambda name, body: "" if name in NAMES else "#" * HEADINGS[name] + " " + body if name in HEADINGS else (
        hold("`" + body + "`") if name in ("texttt", "verb", "lstinline") else body)
    last = None
    while x != last:  # what is taken away can bring a command and a brace together
        x, last = unwrap_commands(x, said), x
    x = WIKI_TABLE.sub(lambda m: _table(m.group()), x)
    x = _settled(TEMPLATE, lambda m: _template(m.group("body")), x)
    x = WIKI_LINK.sub(lambda m: m.group() if not re.search(r"[^\W\d_]", m.group("body")) or m.group("body")[:1] in " -!$" else (
        "" if re.match(r"(?i)(?:category|file|image|datei|bild|kategorie)\s*:", m.group("body")) else m.group("body").rsplit("|", 1)[-1]), x)
    x = WIKI_HEAD.sub(lambda m: "#" * len(m.group("eq")) + " " + m.group("body"), x)
    x = _settled(EMPHASIS, lambda m: m.group("body"), x)
    links: list[str] = []

    def keep_link(m: re.Match) -> str:
        if m.group()[0] == "<" and TAG.match(m.group()):
            return m.group()
        links.append(m.group())
        return f"\x03{len(links) - 1}\x02"

    x = _unwrap(re.sub(r"<[A-Za-z][A-Za-z0-9+.\-]+:[^\s<>]*>", keep_link, x), furniture, hold)
    x = ENTITY.sub(lambda m: html.unescape(m.group()), x)
    x = re.sub("\x03(\\d+)\x02", lambda m: links[int(m.group(1))], x)
    x = _settled(re.compile("\x01(\\d+)\x02"), lambda m: held[int(m.group(1))], x)  # what is held holds earlier pieces only
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+\n", "\n", x)).strip("\n")


def _unwrap(x: str, furniture: frozenset[str], hold) -> str:
    """HTML to text: blocks become lines, headings and items get their marks, silent and furniture text goes."""
    out: list[str] = []
    stack: list[str] = []
    at, pre = 0, None

    def emit(piece: str) -> None:
        if not piece:
            return
        if stack and (SILENT & set(stack) or "/".join(("html", *stack[-DEPTH + 1 :])) in furniture):
            piece = re.sub(r"[^\n]+", "", piece)
        out.append(piece)

    for m in TAG.finditer(x):
        if not _is_tag(m, x):
            continue
        emit(x[at : m.start()])
        at = m.end()
        name, closing = m.group("name").lower(), bool(m.group("close"))
        if name == "pre" and not closing and pre is None:
            pre = len(out)
        if name in VOID or m.group("rest").rstrip().endswith("/"):
            out.append("\n" if name in ("br", "hr") else "")
            continue
        if closing:
            while stack and name in stack and stack.pop() != name:
                pass
            if name == "pre" and pre is not None:
                body = html.unescape("".join(out[pre:])).strip("\n")
                del out[pre:]
                out.append("\n" + hold("```\n" + body + "\n```") + "\n")
                pre = None
                continue
        else:
            if stack and stack[-1] in CLOSED_BY.get(name, ()):
                stack.pop()
            stack.append(name)
        if pre is not None:
            continue
        if re.fullmatch(r"h[1-6]", name):
            out.append("\n" if closing else "\n" + "#" * int(name[1]) + " ")
        elif name == "li":
            out.append("\n" if closing else "\n- ")
        elif name in ("td", "th"):
            out.append(" " if closing else "| ")
        elif name == "code":
            out.append("`")
        elif name not in INLINE:
            out.append("\n")
    emit(x[at:])
    return "".join(out)


def clean_texts(df: DataFrame, key: str, text: str, max_paths: int = 100_000) -> DataFrame:
    """(key, clean): every document's clean text, furniture judged over the whole corpus.

    df: one row per key. Two passes over the texts: path ratios, then rendering.
    The furniture paths are broadcast; paths consist of known element names, at
    most ``DEPTH`` levels, and more than ``max_paths`` of them are an error, not a
    loss.
    """
    furniture = score_paths(materialise(path_ratios(df, text), "paths")).filter("path LIKE 'html/%' AND NOT content").select("path")
    dropped = frozenset(r[0] for r in small_rows(furniture, max_paths, "furniture paths"))
    shared = df.sparkSession.sparkContext.broadcast(dropped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=[key, "clean"])

    return df.filter(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, clean string")
