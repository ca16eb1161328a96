"""Rule-based assessment of documents: a cheap gate, then rules with guards.

Rules are data (``rules``). The gate is one ``rlike`` over an alternation that lets
through every document on which some rule could fire; Python sees only those, where
they lie. What a rule strikes counts less, or not at all, where it is negated,
quoted, explained or listed as something to look for.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.operators import rules as r
from corpusmill.operators.latest import latest
from corpusmill.operators.rules import RULES, Rule
from corpusmill.runtime import spread

# Level thresholds, levels, findings that make a document critical, fields of a document.
THRESHOLDS = ((9.0, "high"), (5.0, "medium"), (2.5, "low"))
LEVELS = ("none", "low", "medium", "high", "critical")
MARKERS = ("hidden_unicode_payload", "bidi_override", "instruction_override", "instruction_override_intl", "refusal_suppression", "jailbreak_tooling")
DOCUMENT = ("name", "description", "body", "path", "metadata", "resources", "tools")
VERDICT = ("level string, score double, findings array<struct<rule:string,weight:double,evidence:string>>, capabilities array<string>")


def gate(text: Column, low: Column, rules: Sequence[Rule] = RULES, needs: Mapping[str, Sequence[str]] = r.NEEDS) -> Column:
    """Whether some rule might strike ``text``: its expression is tried only where one of its strings stands.

    Both are columns of an earlier projection, low being the text in lower case, as they are read many times.
    """
    each = [(x.name, x.pattern) for x in rules]
    each += [("jailbreak", "|".join(p for _, p in r.JAILBREAK)), ("inline_credential", r.INLINE_SECRET), ("concealed_destination", r.ENCODED_ADDRESS), ("split_path_literal", r.SPLIT_PATH)]
    out = text.rlike(r.INVISIBLE)
    for name, pattern in each:
        words = needs.get(name)
        tried = text.rlike(f"(?iU){pattern}")
        if words:
            there = F.lit(False)
            for w in words:
                there = there | low.contains(w)
            tried = there & tried
        out = out | tried
    return F.coalesce(out, F.lit(False))


@lru_cache(maxsize=256)
def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


def _evidence(m: re.Match) -> str:
    return " ".join(m.string[max(0, m.start() - 30) : m.end() + 30].split())[:200]


def in_fence(text: str, at: int) -> bool:
    """Whether a place lies inside a fenced block."""
    return len(re.findall(r"^\s*(?:```|~~~)", text[:at], re.MULTILINE)) % 2 == 1


def set_aside(text: str, m: re.Match, subject: bool) -> bool:
    """Whether what stands before a match negates, quotes or reports it; in a security text a listing reports as well."""
    line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()][-150:]
    if _rx(r.NEGATION).search(line) or _rx(r.QUOTED).search(line) or _rx(r.REPORTED).search(line):
        return True
    return subject and (in_fence(text, m.start()) or line.lstrip().startswith(("|", "- ", "* ")))


def _strike(text: str, rule: Rule, subject: bool, low: str | None = None) -> tuple[re.Match | None, bool]:
    """The first match that its surroundings don't set aside, else the first; and whether it is set aside."""
    first = None
    if low is not None and rule.name in r.NEEDS and not any(w in low for w in r.NEEDS[rule.name]):
        return None, False
    for m in _rx(rule.pattern).finditer(text):
        if not rule.guards or not set_aside(text, m, subject):
            return m, False
        first = first or m
    return first, True


def metadata_text(metadata: str | None) -> str:
    """All strings of a JSON value, keys and values at any depth, in lines; text that isn't JSON as it is."""
    if not metadata or not metadata.strip():
        return ""
    try:
        left, out = [json.loads(metadata)], []
    except ValueError:
        return metadata
    while left:
        x = left.pop()
        if isinstance(x, dict):
            left += [*x.values(), *x]
        elif isinstance(x, list):
            left += x
        elif isinstance(x, str):
            out.append(x)
    return "\n".join(reversed(out))


def encoded_addresses(text: str) -> list[str]:
    """Addresses that stand in a text as Base64."""
    out = []
    for m in re.finditer(r.ENCODED_ADDRESS, text):
        raw = m.group().rstrip("=")
        found = base64.b64decode(raw[: len(raw) // 4 * 4]).decode("utf-8", "replace")
        if re.match(r"https?://[\w.-]+", found):
            out.append(found.split()[0])
    return out


def inspect_document(doc: Mapping[str, object], rules: Sequence[Rule] = RULES, combinations=r.COMBINATIONS) -> dict:
    """Level, score, findings and capabilities of one document.

    doc: the fields of ``DOCUMENT`` that are known; metadata is JSON, resources the
    text of bundled runnable files, tools a list. Null fields are empty.
    """
    get = lambda k: str(doc.get(k) or "")
    header = f"{get('name')}\n{get('description')}"
    text = f"{header}\n{get('body')}"
    about = f"{header} {get('path')}"
    subject, operations = bool(_rx(r.SECURITY).search(about)), bool(_rx(r.OPERATIONS).search(about))
    findings: list[tuple[str, float, str]] = []
    capable: set[str] = set()

    def note(rule: str, weight: float, evidence: str = "", capability: str | None = None) -> None:
        findings.append((rule, weight, evidence))
        if capability:
            capable.add(capability)

    if not text.isascii():
        tags, selectors = len(re.findall("[\U000E0000-\U000E007F]", text)), len(re.findall("[\U000E0100-\U000E01EF]", text))
        turned = re.search("[\u202d\u202e]", text)
        if tags >= 2 or selectors >= 2:
            note("hidden_unicode_payload", 10.0, f"{tags} tags, {selectors} selectors")
        elif turned:
            note("bidi_override", 10.0, f"U+{ord(turned.group()):04X}")
        elif re.search("[\u202a-\u202c\u2066-\u2069]|\u200b{3,}|\u200c{3,}|\u200d{3,}", text):
            note("invisible_chars_present", 0.0)

    severe = {x.name for x in rules if x.kind == "severe"}
    low = text.lower()
    for rule in rules:
        m, aside = _strike(text, rule, subject, low)
        if not m:
            continue
        if aside:
            if rule.kind == "severe":
                note(f"{rule.name}_as_signature", rule.weight * r.SIGNATURE_LEAVES, _evidence(m))
            else:
                note(f"{rule.name}_discussed", 0.0, _evidence(m))
        elif rule.name == "concealment":
            ways = {x.group()[:14].lower() for x in _rx(rule.pattern).finditer(text) if not set_aside(text, x, subject)}
            capable.update(["concealment", "layered_concealment"][: min(len(ways), 2)])
            note("concealment" if len(ways) < 2 else "layered_concealment", rule.weight * min(len(ways), 2), _evidence(m))
        elif rule.kind == "capability":
            leaves = r.SECURITY_LEAVES if subject else r.OPERATIONS_LEAVE if operations and rule.name in r.OPERATIONS_FAMILIES else 1.0
            note(rule.name, rule.weight * leaves, _evidence(m), rule.name)
        else:
            note(rule.name, rule.weight, _evidence(m), {"severe": rule.name, "notice": "concealment"}.get(rule.kind))

    jailbreak = [name for name, p in r.JAILBREAK if _rx(p).search(text)]
    if len(jailbreak) >= 2:
        note(*(("jailbreak_tooling", 10.0) if len(jailbreak) > 2 else ("jailbreak_technique", 3.0)), ", ".join(jailbreak), None if len(jailbreak) > 2 else "jailbreak_technique")
    if _rx(r.OFFENSIVE).search(header):
        capable.add("declared_offensive_purpose")
    if address := encoded_addresses(text):
        note("concealed_destination", 8.0, address[0][:120], "network_egress")
    if m := re.search(r.INLINE_SECRET, text):
        note("inline_credential", 7.0, m.group()[:12] + "\u2026")  # never the whole value

    if files := get("resources"):
        for rule in rules:
            if rule.kind in ("severe", "capability") and (m := _rx(rule.pattern).search(files)):
                note(f"{rule.name}_in_bundled_file", rule.weight, _evidence(m), rule.name)
        if _rx(r.BUNDLED_READ).search(files) and (m := _rx(r.BUNDLED_SEND).search(files)):
            note("bundled_secret_egress", 7.0, _evidence(m), "credential_egress")
        if m := _rx(r.SPLIT_PATH).search(files):
            note("split_path_literal", 4.0, _evidence(m), "concealment")
    if said := metadata_text(get("metadata")):
        struck = sorted(x.name for x in rules if _strike(said, Rule(x.name, x.kind, 0.0, x.pattern), False, said.lower())[0])
        if struck:
            note("frontmatter_instruction", 5.0, ", ".join(struck[:3]), "frontmatter_instruction")

    for members, weight in combinations:
        if capable.issuperset(members):
            note("+".join(members), weight * (r.SECURITY_LEAVES if subject else 1.0))
    tools = doc.get("tools")
    if tools is not None and {str(t).lower() for t in tools} & set(r.SHELL_TOOLS) and not (subject or operations or _rx(r.SHELL_NEED).search(text)):
        note("unjustified_shell", 2.5)

    score = sum(w for _, w, _ in findings)
    struck = {name for name, _, _ in findings} & severe
    if score >= 10.0 and any(name in MARKERS and w > 0 for name, w, _ in findings):
        level = "critical"
    elif struck and (capable - severe or len(struck) > 1):
        level = "high"
    else:
        level = next((name for cut, name in THRESHOLDS if score >= cut), "none")
    return {"level": level, "score": round(score, 3), "capabilities": sorted(capable),
            "findings": [{"rule": name, "weight": round(w, 3), "evidence": e} for name, w, e in findings]}


def assess(df: DataFrame, fields: Column | Mapping[str, Column], rules: Sequence[Rule] = RULES, keep: Sequence[str] | None = None,
           combinations=r.COMBINATIONS) -> DataFrame:
    """Add ``verdict``: level, score, findings and capabilities.

    fields: the body, or the known fields of ``DOCUMENT``.
    keep: columns of the result, by default all of ``df``.
    One scan without a shuffle: only what passes the gate reaches Python, in the task
    that read it, equal documents of a batch once. What doesn't, and null texts, get
    level none. A shell tool without need is looked for in gated documents and in
    those that declare such a tool.
    """
    given = dict(fields) if isinstance(fields, Mapping) else {"body": fields}
    columns = list(keep) if keep is not None else df.columns
    texts = [k for k in DOCUMENT if k in given and k != "tools"]
    passes = gate(F.col("_whole"), F.col("_low"), rules)
    inputs = [*texts, *(["tools"] if "tools" in given else [])]
    whole = F.concat_ws("\n", *[given[k] for k in texts])
    rows = spread(df.select(*columns, *[given[k].alias(f"_{k}") for k in inputs], whole.alias("_whole")))
    rows = rows.withColumn("_low", F.lower("_whole"))
    given = {k: F.col(f"_{k}") for k in inputs}
    if "resources" in given:
        passes = passes | F.coalesce(given["resources"].rlike(f"(?iU){r.BUNDLED_READ}"), F.lit(False))
    head = [given[k] for k in ("name", "description") if k in given]
    if head:
        passes = passes | F.concat_ws("\n", *head).rlike(f"(?iU){r.OFFENSIVE}")
    if "tools" in given:
        passes = passes | F.coalesce(F.arrays_overlap(F.transform(given["tools"], F.lower), F.array(*[F.lit(t) for t in r.SHELL_TOOLS])), F.lit(False))
    document = F.when(passes, F.struct(F.lit(True).alias("gated"), *[given[k].alias(k) for k in inputs]))  # one expression: the gate runs once
    empty = {"level": "none", "score": 0.0, "findings": [], "capabilities": []}

    @pandas_udf(VERDICT)
    def run(documents: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple, dict] = {}
        out = []
        for on, *values in documents.itertuples(index=False, name=None):
            if on is not True:
                out.append(empty)
                continue
            values = [None if v is None or v != v else v for v in values] if "tools" not in inputs else values
            key = tuple(v if v is None or isinstance(v, str) else tuple(v) for v in values)
            if key not in known:
                known[key] = inspect_document(dict(zip(inputs, values)), rules, combinations)
            out.append(known[key])
        return pd.DataFrame(out, columns=["level", "score", "findings", "capabilities"])

    return rows.select(*columns, run(document).alias("verdict"))


def moved(old: DataFrame, new: DataFrame, key: str, level: str = "risk_level") -> DataFrame:
    """(key, old, new) of the rows whose level changed, null-safe."""
    joined = old.select(key, F.col(level).alias("old")).join(new.select(key, F.col(level).alias("new")), key)
    return joined.filter(~F.col("old").eqNullSafe(F.col("new")))


# How far each kind of evidence is trusted.
PRECISION = {
    "rule_critical_and_model_harm": 0.98, "rule_critical_and_mismatch": 0.96, "model_harm_severe_alone": 0.95, "rule_critical_alone": 0.86,
    "model_mismatch_alone": 0.90, "rule_high_and_model_harm": 0.92, "rule_high_alone": 0.55, "rule_medium_alone": 0.30,
    "addresses_reviewer_alone": 0.10, "rule_low_alone": 0.10,
}
BLOCK, FLAG = 0.80, 0.25


def decide(df: DataFrame, block: float = BLOCK, flag: float = FLAG, precision: Mapping[str, float] = PRECISION) -> DataFrame:
    """Add ``action``, ``confidence``, ``basis`` and ``reasons``: the best supported kind of evidence decides.

    df: columns level, harm, mismatch, addressed (the last three null where no model
    spoke, which is no information), and optionally capabilities and findings
    (array of structs with rule and weight, as in a verdict). Harm that the model
    reports on a document it was primed for (level medium or high) needs a mismatch;
    a mismatch needs harm. A block needs more than a low level, else it is a flag; a
    document that declares an offensive purpose and has no finding against its
    operator is flagged too, unless it is critical.
    """
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    serious, harmed = yes(c("harm").isin("serious", "severe")), yes(c("harm").isin("minor", "serious", "severe"))
    odd, addressed = harmed & yes(c("mismatch")), yes(c("addressed"))
    critical = yes(c("level") == "critical")
    primed = yes(c("level").isin("medium", "high"))
    believed = serious & (odd | ~primed)
    holds = {
        "rule_critical_and_model_harm": critical & serious, "rule_critical_and_mismatch": critical & odd, "rule_critical_alone": critical,
        "rule_high_and_model_harm": believed & primed, "model_harm_severe_alone": believed, "model_mismatch_alone": odd,
        "rule_high_alone": yes(c("level") == "high"), "rule_medium_alone": yes(c("level") == "medium"), "addresses_reviewer_alone": addressed,
        "rule_low_alone": yes(c("level") == "low"),
    }
    each = F.array(*[F.when(cond, F.struct(F.lit(precision[name]).alias("confidence"), F.lit(-i).alias("i"), F.lit(name).alias("basis")))
                     for i, (name, cond) in enumerate(holds.items())])
    rows = df.withColumn("_b", F.array_max(each))
    conf, basis = F.coalesce(c("_b.confidence"), F.lit(0.0)), F.coalesce(c("_b.basis"), F.lit("no_evidence"))
    unsupported = (conf >= block) & yes(c("level").isin("none", "low"))
    declared = yes(F.array_contains("capabilities", "declared_offensive_purpose")) if "capabilities" in df.columns else F.lit(False)
    against = (yes(F.exists("findings", lambda x: (x["weight"] > 0) & x["rule"].isin(*r.OPERATOR_DIRECTED)))
               if "findings" in df.columns else F.lit(False))
    honest = (conf >= block) & ~unsupported & ~critical & declared & ~against
    action = F.when(unsupported | honest, "flag").when(conf >= block, "block").when(conf >= flag, "flag").otherwise("allow")
    basis = F.when(unsupported, F.concat(basis, F.lit("_model_only"))).when(honest, F.concat(basis, F.lit("_declared_offensive"))).otherwise(basis)
    rules = F.array_join(F.slice(F.transform("findings", lambda x: x["rule"]), 1, 3), ", ") if "findings" in df.columns else F.lit("")
    reasons = F.filter(F.array(
        F.when(critical, F.concat(F.lit("rules: unambiguous marker ("), rules, F.lit(")"))),
        F.when(harmed, F.concat(F.lit("model: harm if followed = "), c("harm"))), F.when(odd, F.lit("model: instructions exceed the stated purpose")),
        F.when(addressed, F.lit("model: contains text addressed to a reviewer")), F.when(unsupported, F.lit("flagged on the model's judgement alone")),
        F.when(honest | (declared & (action != "allow")), F.lit("declares an offensive-security purpose")),
    ), lambda x: x.isNotNull())
    return (rows.withColumn("action", action).withColumn("confidence", conf).withColumn("basis", basis).withColumn("reasons", reasons).drop("_b"))


def override(df: DataFrame, decisions: DataFrame, key: str = "content_hash") -> DataFrame:
    """Human decisions on a content beat computed ones, on every copy."""
    d = decisions.select(F.col(key).alias("_k"), F.col("action").alias("_a"))
    return df.join(d, F.col(key) == F.col("_k"), "left").withColumn("action", F.coalesce("_a", "action")).drop("_k", "_a")


def record_override(decisions: DataFrame, new: DataFrame, key: str = "content_hash", at: str = "decided_at") -> DataFrame:
    """All human decisions with ``new`` ones recorded: per content the latest counts."""
    columns = [c for c in decisions.columns if c != key]
    return latest(decisions.unionByName(new), key, at, columns)


def override_counts(decisions: DataFrame) -> DataFrame:
    """(action, n): how many contents people decided which way."""
    return decisions.groupBy("action").agg(F.count("*").alias("n"))


def excerpt_around(text: str, places: Sequence[tuple[int, int]], limit: int = 6000, margin: int = 400) -> str:
    """The beginning of a text and what stands around some places, joined where they touch, at most ``limit`` characters.

    Made for a model's prompt, whose size is bounded; verdicts never depend on it.
    """
    spans = sorted((max(0, s - margin), min(len(text), e + margin)) for s, e in [(0, min(len(text), margin)), *places])
    merged: list[list[int]] = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return "\n[...]\n".join(text[s:e] for s, e in merged)[:limit]


def review(df: DataFrame, fields: Mapping[str, Column], model, schema: str = "harm string, mismatch boolean, addressed boolean") -> DataFrame:
    """Add ``review``: what a model says of each document, null where it fails.

    model: from a list of prompts to a list of dicts (or None) with the fields of
    ``schema``. It is called batch by batch inside the tasks; null prompts aren't sent.
    """
    prompt = F.concat_ws("\n\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])

    @pandas_udf(schema)
    def run(prompts: pd.Series) -> pd.DataFrame:
        asked = prompts.dropna()
        try:
            answers = dict(zip(asked.index, model(asked.tolist()) if len(asked) else []))
        except Exception:  # noqa: BLE001  (a reviewer that fails tells nothing)
            answers = {}
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.DataFrame([{n: (answers.get(i) or {}).get(n) for n in names} for i in prompts.index], columns=names)

    return df.withColumn("review", run(prompt))


def disclosure(action: Column, level: Column) -> Column:
    """What is told about a row: its decision, or, without one, whether it was looked at."""
    return F.when(action.isNotNull(), action).when(F.coalesce(level, F.lit("none")) == "none", "allow").otherwise("unassessed")
