"""Compliance profiles: declarative checks compiled to column expressions, evaluated for all documents at once."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomweave.functions.identity import ABSENT, effective_license, profile_algorithm
from bomweave.model import Workspace

SCHEMA = "bomweave-profile/v3"
#: Limits of a profile.
MAX_BYTES, MAX_CHECKS, MAX_NAME, MAX_ID, MAX_PATTERN, MAX_VALUES, MAX_VALUE, MAX_ALGORITHMS, MAX_ALGORITHM = 65_536, 200, 120, 64, 500, 100, 200, 8, 32
DOCUMENT_FIELDS = ["name", "namespace", "created", "creators", "dataLicense", "comment"]
PACKAGE_FIELDS = ["version", "supplier", "purl", "uniqueId", "checksum", "license", "downloadLocation", "purpose", "copyright", "originator"]
TYPES = ["document-field", "relationships", "created-recency", "package-coverage"]
BASELINES = {"spdx-3": "SPDX 3.0.1 or later", "cdx-1.6": "CycloneDX 1.6 or later"}
#: Characters of a value that a result shows.
SHOWN = 120


@dataclass(frozen=True)
class Check:
    type: str
    id: str | None = None
    label: str | None = None
    field: str | None = None
    pattern: str | None = None
    values: tuple[str, ...] | None = None
    threshold: float | None = None
    min_count: int = 1
    max_age_days: float | None = None
    algorithms: tuple[str, ...] | None = None

    def title(self) -> str:
        if self.label:
            return self.label
        return {"document-field": f"Document {self.field}", "relationships": "Relationships", "created-recency": f"Created within {self.max_age_days:g} days" if self.max_age_days is not None else ""}.get(self.type, f"Packages with {self.field}")


@dataclass(frozen=True)
class Profile:
    name: str
    checks: tuple[Check, ...] = field(default_factory=tuple)
    description: str = ""
    baselines: tuple[str, ...] = ()


def _field(name: str, **more) -> Check:
    return Check("document-field", field=name, **more)


def _cover(name: str, **more) -> Check:
    return Check("package-coverage", field=name, **more)


#: The built-in profiles.
NTIA = Profile("NTIA minimum elements", (_field("creators"), _field("created"), _field("namespace"), Check("relationships"), _cover("version"), _cover("supplier"), _cover("uniqueId"), _cover("checksum"), _cover("license")))
CISA = Profile("CISA 2026 minimum elements", (
    _field("creators", pattern="^(Person|Organization):"), _field("created"), _field("creators", pattern="^Tool:", id="tool"), Check("relationships"),
    _cover("originator"), _cover("version"), _cover("uniqueId"), _cover("checksum"), _cover("license"),
))
BSI = Profile("BSI TR-03183-2", (
    _field("creators", pattern="(Person|Organization):.*(@|https?://)"), _field("created"), Check("relationships"), _cover("version", threshold=100), _cover("supplier", threshold=100),
    _cover("license", threshold=100), _cover("checksum", threshold=100, algorithms=("SHA512",)), _cover("uniqueId"),
), baselines=("spdx-3", "cdx-1.6"))
DELIVERY = Profile("Component descriptor essentials", (_field("name"), _field("creators"), _field("created"), Check("relationships"), _cover("version", threshold=100), _cover("checksum"), _cover("downloadLocation"), _cover("uniqueId")))
BUILT_IN = {"ntia": NTIA, "cisa": CISA, "bsi": BSI, "delivery": DELIVERY}


def select(profile_id: str | None, model: str, extra: dict[str, Profile] | None = None) -> Profile:
    """The chosen profile, or the default of a document model where the id is unknown."""
    known = BUILT_IN | (extra or {})
    return known.get(profile_id or "", DELIVERY if model == "ocm" else NTIA)


def _texts(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def validate(raw: object) -> tuple[Profile | None, list[str]]:
    """A profile from its JSON value, or None and everything that is wrong with it."""
    wrong: list[str] = []
    if not isinstance(raw, dict):
        return None, ["not an object"]
    version = (m := re.fullmatch(r"[a-z-]+-profile/v([123])", str(raw.get("schema")))) and int(m[1])
    if not version:
        wrong.append("schema: unknown")
    name = raw.get("name")
    if not isinstance(name, str) or not 0 < len(name) <= MAX_NAME:
        wrong.append(f"name: 1 to {MAX_NAME} characters")
    requires, baselines = raw.get("requires"), []
    if requires is not None:
        if version and version < 3:
            wrong.append("requires: only from version 3")
        spec = requires.get("spec") if isinstance(requires, dict) else None
        baselines = spec if isinstance(spec, list) else [spec]
        if not baselines or any(b not in BASELINES for b in baselines):
            wrong.append("requires: unknown baseline")
    checks, seen, out = raw.get("checks"), set(), []
    if not isinstance(checks, list) or not 0 < len(checks) <= MAX_CHECKS:
        wrong.append(f"checks: 1 to {MAX_CHECKS}")
        checks = []
    for i, c in enumerate(checks):
        at = f"checks[{i}]"
        if not isinstance(c, dict) or c.get("type") not in TYPES:
            wrong.append(f"{at}: unknown type")
            continue
        kind, own = c["type"], c.get("id")
        if own is not None and (not isinstance(own, str) or not 0 < len(own) <= MAX_ID or own in seen):
            wrong.append(f"{at}.id: a new text of 1 to {MAX_ID} characters")
        seen.add(own)
        if kind == "document-field" and c.get("field") not in DOCUMENT_FIELDS or kind == "package-coverage" and c.get("field") not in PACKAGE_FIELDS:
            wrong.append(f"{at}.field: unknown")
        flag = kind in ("relationships", "created-recency") or c.get("field") in ("uniqueId", "checksum")
        pattern = c.get("pattern")
        if pattern is not None:
            try:
                if flag or not isinstance(pattern, str) or len(pattern) > MAX_PATTERN:
                    raise ValueError
                re.compile(pattern)
            except (re.error, ValueError):
                wrong.append(f"{at}.pattern: not usable here")
        values = c.get("values")
        if values is not None and (flag or not _texts(values) or not 0 < len(values) <= MAX_VALUES or any(len(v) > MAX_VALUE for v in values)):
            wrong.append(f"{at}.values: not usable here")
        threshold = c.get("threshold")
        if threshold is not None and (kind != "package-coverage" or isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 100):
            wrong.append(f"{at}.threshold: 0 to 100, for coverage")
        age = c.get("maxAgeDays")
        if (kind == "created-recency") != (age is not None) or age is not None and (isinstance(age, bool) or not isinstance(age, (int, float)) or age <= 0):
            wrong.append(f"{at}.maxAgeDays: a positive number, for recency")
        least = c.get("minCount", 1)
        if isinstance(least, bool) or not isinstance(least, int) or least < 1:
            wrong.append(f"{at}.minCount: a positive whole number")
        algorithms = c.get("algorithms")
        if algorithms is not None and (c.get("field") != "checksum" or (version or 0) < 2 or not _texts(algorithms) or not 0 < len(algorithms) <= MAX_ALGORITHMS or any(not 0 < len(a) <= MAX_ALGORITHM for a in algorithms)):
            wrong.append(f"{at}.algorithms: names, for checksums, from version 2")
        if not wrong:
            out.append(Check(kind, own, c.get("label"), c.get("field"), pattern, tuple(values) if values else None, threshold, least, age, tuple(algorithms) if algorithms else None))
    return (None, wrong) if wrong else (Profile(name, tuple(out), raw.get("description") or "", tuple(baselines)), [])


def sniff(text: str) -> bool:
    """Whether a text is a profile: small, and a JSON object whose schema says so."""
    if len(text.encode()) > MAX_BYTES or "-profile/v" not in text:
        return False
    try:
        raw = json.loads(text)
    except ValueError:
        return False
    return isinstance(raw, dict) and bool(re.fullmatch(r"[a-z-]+-profile/v\d+", str(raw.get("schema"))))


def _some(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _fits(check: Check, c: Column) -> Column:
    out = F.lit(True)
    if check.pattern is not None:
        out &= c.rlike(check.pattern)
    if check.values is not None:
        out &= c.isin(*check.values)
    return out


def _document_value(name: str) -> Column:
    return F.col({"dataLicense": "data_license"}.get(name, name))


def _document_passes(check: Check) -> Column:
    if check.field == "creators":
        return F.coalesce(F.exists("creators", lambda c: _fits(check, c)), F.lit(False)) & (F.coalesce(F.size("creators"), F.lit(0)) > 0)
    value = _document_value(check.field or "")
    return _some(value) & F.coalesce(_fits(check, value), F.lit(False))


def _package_satisfies(check: Check) -> Column:
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    known = lambda c: F.when(~F.col(c).isin(*ABSENT), F.col(c))
    if check.field == "uniqueId":
        return _some(F.col("purl")) | has("external_refs")
    if check.field == "checksum":
        if not check.algorithms:
            return has("checksums")
        allowed = [a.upper().replace("-", "") for a in check.algorithms]
        return F.coalesce(F.exists("checksums", lambda c: profile_algorithm(c["algorithm"]).isin(*allowed)), F.lit(False))
    value = {
        "version": F.col("version"), "purl": F.col("purl"), "purpose": F.col("purpose"), "supplier": known("supplier"), "downloadLocation": known("download_location"),
        "copyright": known("copyright"), "originator": known("originator"), "license": effective_license(F.col("license_concluded"), F.col("license_declared")),
    }[check.field or ""]
    return _some(value) & F.coalesce(_fits(check, value), F.lit(False))


def _baseline(token: str) -> Column:
    if token == "spdx-3":
        return F.col("model") == "spdx-3"
    number = lambda i: F.regexp_extract("version", r"^CycloneDX-(\d+)\.(\d+)", i).try_cast("int")
    return (F.col("model") == "cyclonedx") & F.coalesce((number(1) > 1) | ((number(1) == 1) & (number(2) >= 6)), F.lit(False))


def _shown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "missing").when(F.length(c) > SHOWN, F.concat(F.substring(c, 1, SHOWN - 3), F.lit("..."))).otherwise(c)


def evaluate(ws: Workspace, profile: Profile, now: str | None = None) -> DataFrame:
    """(doc_id, seq, id, label, kind, pass, actual, satisfied, total, percent, threshold): a row a document and check.

    One aggregation over packages counts all coverage checks; now (an ISO time) is needed by recency checks only.
    """
    covers = [(i, c) for i, c in enumerate(profile.checks) if c.type == "package-coverage"]
    counts = ws.element.where("kind = 'package'").groupBy("doc_id").agg(F.count("*").alias("_total"), *(F.count_if(_package_satisfies(c)).alias(f"_n{i}") for i, c in covers))
    related = ws.relationship.groupBy("doc_id").agg(F.count("*").alias("_related"))
    facts = ws.document.join(counts, "doc_id", "left").join(related, "doc_id", "left").na.fill(0, ["_total", "_related", *(f"_n{i}" for i, _ in covers)])
    none_n, none_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    rows = []

    def add(own_id: str, label: str, kind: str, passed: Column, actual: Column, n: Column = none_n, total: Column = none_n, percent: Column = none_n, threshold: Column = none_d) -> None:
        values = {"seq": F.lit(len(rows)), "id": F.lit(own_id), "label": F.lit(label), "kind": F.lit(kind), "pass": passed, "actual": actual, "satisfied": n, "total": total, "percent": percent, "threshold": threshold}
        rows.append(F.struct(*(c.alias(name) for name, c in values.items())))

    if profile.baselines:
        add("format-baseline", "Format baseline: " + " or ".join(BASELINES[b] for b in profile.baselines), "boolean", reduce(lambda a, b: a | b, map(_baseline, profile.baselines)), F.col("version"))
    for i, c in enumerate(profile.checks):
        own = c.id or f"{c.type}-{i}"
        if c.type == "document-field":
            shown = F.array_join("creators", " · ") if c.field == "creators" else _document_value(c.field or "")
            add(own, c.title(), "boolean", _document_passes(c), _shown(shown))
        elif c.type == "relationships":
            add(own, c.title(), "boolean", F.col("_related") >= c.min_count, F.col("_related").cast("string"))
        elif c.type == "created-recency":
            age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("created").try_cast("timestamp"))
            add(own, c.title(), "boolean", F.coalesce(age <= F.lit(float(c.max_age_days or 0)) * 86_400_000, F.lit(False)), F.coalesce("created", F.lit("missing")))
        else:
            n, total = F.col(f"_n{i}"), F.col("_total")
            percent = F.when(total == 0, 100).otherwise(F.floor((200 * n + total) / (2 * F.when(total > 0, total)))).cast("long")
            passed = F.lit(True) if c.threshold is None else n * 100 >= F.lit(float(c.threshold)) * total
            add(own, c.title(), "coverage", passed, F.lit(None).cast("string"), n, total, percent, F.lit(c.threshold).cast("double"))
    return facts.select("doc_id", F.inline(F.array(*rows)))


def tallies(results: DataFrame) -> DataFrame:
    """(doc_id, gated_passed, gated_failed, informational): a coverage check without a threshold gates nothing."""
    gated = (F.col("kind") == "boolean") | F.col("threshold").isNotNull()
    return results.groupBy("doc_id").agg(F.count_if(gated & F.col("pass")).alias("gated_passed"), F.count_if(gated & ~F.col("pass")).alias("gated_failed"), F.count_if(~gated).alias("informational"))


def markdown(results: DataFrame, profile: Profile, doc_id: str, name: str) -> str:
    """The report of one document."""
    rows = results.where(F.col("doc_id") == doc_id).orderBy("seq").collect()
    text = [f"# {profile.name}: {name}", ""] + ([f"> {profile.description}", ""] if profile.description else [])
    text += [f"- [{'x' if r['pass'] else ' '}] {r.label}: {r.actual}" for r in rows if r.kind == "boolean"]
    cover = [r for r in rows if r.kind == "coverage"]
    if cover:
        text += ["", "| Coverage | Packages | Percent | Threshold |", "| --- | --- | --- | --- |"]
        text += [f"| {r.label} | {r.satisfied}/{r.total} | {r.percent} % | {'' if r.threshold is None else f'{r.threshold:g} % ' + ('passed' if r['pass'] else 'failed')} |" for r in cover]
    return "\n".join([*text, ""])
