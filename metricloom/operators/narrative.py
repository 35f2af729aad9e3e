"""Narratives for personas: evidence scoped to them, and release only if every number is in the evidence."""

from __future__ import annotations

import re
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.contracts import Persona
from ..sources.scratch import stored

NUMBER = r"-?\d[\d,]*\.?\d*"
_NUMBER = re.compile(NUMBER)
#: Numbers that need no evidence, and scales that amounts are told in.
SAFE = frozenset({"0", "1", "2", "3", "100", "95", "90"})
SCALES = (1e5, 1e7, 1e3, 1e6)


def number_tokens(text: Column) -> Column:
    """The numbers of a text, without thousands separators and trailing dots."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"\.$", ""))


def ungrounded(texts: DataFrame, vocabulary: DataFrame, text: str = "text", key: str = "case") -> DataFrame:
    """Per text its numbers that the vocabulary lacks, and whether it may be released. A vocabulary (case, token) is
    of one case each, one without that column of all texts."""
    told = F.filter(F.array_distinct(number_tokens(F.col(text))), lambda t: ~t.isin(*SAFE))
    tokens = texts.select(key, F.explode_outer(told).alias("token"))
    on = [key, "token"] if key in vocabulary.columns else ["token"]
    known = vocabulary.select(*on).distinct().withColumn("_known", F.lit(True))
    rows = tokens.join(known, on, "left")
    missing = F.sort_array(F.collect_list(F.when(F.col("_known").isNull() & F.col("token").isNotNull(), F.col("token"))))
    return rows.groupBy(key).agg(missing.alias("missing")).select(key, F.array_join("missing", ",").alias("missing"), (F.size("missing") == 0).alias("passed"))


def number_forms(x: float) -> set[str]:
    """How a number may be written: up to two decimals, signed or not, in percent or scaled."""
    out = set()
    for v in {x, abs(x)} | {abs(x) / s for s in SCALES} | {abs(x) * 100}:
        out |= {f"{v:.0f}", f"{v:.1f}", f"{v:.2f}", str(round(v))}
    return out


def vocabulary(evidence: Any) -> set[str]:
    """All tokens that a narrative of the evidence may use; truth values are not numbers."""
    if isinstance(evidence, dict):
        return set().union(set(), *map(vocabulary, evidence.keys()), *map(vocabulary, evidence.values()))
    if isinstance(evidence, (list, tuple, set)):
        return set().union(set(), *map(vocabulary, evidence))
    if isinstance(evidence, bool) or evidence is None:
        return set()
    if isinstance(evidence, (int, float)):
        return number_forms(float(evidence)) if abs(float(evidence)) < float("inf") else set()
    return {t.replace(",", "").rstrip(".") for t in _NUMBER.findall(str(evidence))}


def grounded(text: str, evidence: Any) -> list[str]:
    """The text's numbers without evidence."""
    known = vocabulary(evidence) | SAFE
    return [t for t in (t.replace(",", "").rstrip(".") for t in _NUMBER.findall(text)) if t not in known]


def scrubbed(evidence: Any, persona: Persona, regions: tuple[str, ...]) -> Any:
    """The evidence without keys, list items and texts that name regions outside the persona's, or restricted
    columns."""
    foreign = {r.lower() for r in regions if persona.regions and r not in persona.regions} | {c.lower() for c in persona.restricted}
    named = lambda s: any(re.search(rf"(?<![a-z]){re.escape(f)}(?![a-z])", str(s).lower()) for f in foreign)

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items() if not named(k) and not (isinstance(v, str) and named(v))}
        if isinstance(x, (list, tuple)):
            return [walk(v) for v in x if not (isinstance(v, str) and named(v))]
        return x

    return walk(evidence)


class Renderer(Protocol):
    def render(self, evidence: dict, persona: Persona) -> str: ...


class Templates:
    """The built-in renderer: two styles from fixed sentences."""

    def render(self, evidence: dict, persona: Persona) -> str:
        e = evidence
        change = e["gap_pct"]
        way = "below" if change < 0 else "above"
        lines = [f"{e['metric']} in week {e['week']} was {abs(change):.1f}% {way} expectation ({e['gap']:,.0f})."]
        if e.get("slice"):
            lines.append(f"Most of it sits in {e['slice']}.")
        if e.get("bridge"):
            lines.append(f"There, {e['bridge']['dominant']} moved revenue most ({e['bridge'][e['bridge']['dominant']]:,.0f}).")
        if e.get("funnel") and persona.style != "strategic":
            lines.append(f"In units, the change comes from {e['funnel']}.")
        if e["mode"] == "abstain":
            lines.append("The evidence does not support a cause; no action is recommended.")
            lines += [f"What would settle it: {t}." for t in e.get("tests", [])]
            return " ".join(lines)
        for cause in e.get("causes", []):
            lines.append(f"Cause: {cause['label']} (impact {cause['impact']:,.0f}, between {cause['low']:,.0f} and {cause['high']:,.0f})." if "low" in cause else f"Cause: {cause['label']} (impact {cause['impact']:,.0f}).")
        if e["mode"] == "competing":
            lines.append("These explanations compete: their effects overlap.")
        for out in e.get("ruled_out", []):
            lines.append(f"Ruled out: {out['label']} ({out['reason']}).")
        if persona.style == "strategic":
            lines.append(f"Confidence {e['confidence']:.2f}. The best bundle costs {e['bundle_cost']:,.0f} and frees {e['bundle_value']:,.0f} a week.")
            if e.get("payback"):
                lines.append(f"It pays back in {e['payback']:.1f} weeks.")
            if e.get("unreleased"):
                lines.append(f"Held back by the gates of the portfolio: {', '.join(e['unreleased'])}.")
        elif e.get("actions"):
            lines.append("Your actions: " + "; ".join(e["actions"]) + ".")
            lines.append("Compare the weekly value with the bundle's, and review after four weeks.")
        return " ".join(lines)


class ExternalRenderer:
    """A renderer that asks a client, which the caller provides; there is no default."""

    def __init__(self, client: Any):
        if client is None:
            raise ValueError("an external renderer needs a client")
        self.client = client

    def render(self, evidence: dict, persona: Persona) -> str:
        return self.client(evidence, persona)


def released(evidence: dict, persona: Persona, regions: tuple[str, ...], renderer: Renderer | None = None) -> dict:
    """The persona's narrative, or none if it has numbers that the evidence as the persona may see it lacks."""
    own = scrubbed(evidence, persona, regions)
    text = (renderer or Templates()).render(own, persona)
    missing = grounded(text, own)
    return {"persona": persona.id, "text": None if missing else text, "missing": missing, "passed": not missing, "evidence": own}


# ---- evidence as data ------------------------------------------------------------------------------------------


def evidence_leaves(rows: DataFrame, evidence: str, key: str = "case", most: int = 64) -> DataFrame:
    """key, path ($.a[0].b), names (the fields on it) and value (variant) of every value in JSON evidence that is neither
    object nor array, at any depth: a round unpacks one level of what is still packed. Texts that aren't JSON, and empty objects and arrays, have
    none. Evidence deeper than `most` levels is an error, not cut."""
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("case"), F.lit("$").alias("path"), F.array().cast("array<string>").alias("names"), F.try_parse_json(F.col(evidence)).alias("v")).where("v IS NOT NULL")
    packed = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)(<|$)")
    found = None
    for depth in range(most + 1):
        level = stored(level.withColumn("packed", packed), "evidence")
        own = level.where("NOT packed").select("case", "path", "names", "v")
        found = own if found is None else found.unionByName(own)
        rest = level.where("packed")
        if rest.isEmpty():
            return found.select(F.col("case").alias(key), "path", "names", F.col("v").alias("value"))
        if depth < most:
            level = spark.sql("SELECT case, concat(path, CASE WHEN key IS NULL THEN concat('[', pos, ']') ELSE concat('.', key) END) AS path, CASE WHEN key IS NULL THEN names ELSE array_append(names, key) END AS names, value AS v FROM {rest}, LATERAL variant_explode({rest}.v)", rest=rest)
    raise ValueError(f"evidence is deeper than {most} levels")


def number_form_columns(x: Column) -> Column:
    """How a number may be written (see number_forms()), as an array of distinct texts; null for what is not finite."""
    ways = F.concat(F.when(x > 0, F.array().cast("array<double>")).otherwise(F.array(x)), F.array(F.abs(x), *(F.abs(x) / s for s in SCALES), F.abs(x) * 100))
    forms = F.flatten(F.transform(ways, lambda v: F.array(*(F.call_function("format_number", v, F.lit(p)) for p in ("0", "0.0", "0.00")))))
    return F.when(F.abs(x) < float("inf"), F.array_distinct(forms))


def evidence_vocabulary(rows: DataFrame, evidence: str, key: str = "case") -> DataFrame:
    """key and token, distinct: every number that a text on JSON evidence may use. Numbers give all forms they may be
    written in, texts and names of fields the numbers in them; truth values and nulls give none. A case's numbers meet
    before they are written out, so that they move once each and not in all their forms."""
    leaves = evidence_leaves(rows, evidence, key).withColumn("kind", F.schema_of_variant("value"))
    none, kind = F.array().cast("array<string>"), F.col("kind")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("value", "$", "double"))
    told = F.coalesce(F.when(kind == "STRING", number_tokens(F.try_variant_get("value", "$", "string"))), none)
    texts = F.array_union(told, F.flatten(F.transform("names", number_tokens)))
    cases = leaves.select(key, number.alias("number"), F.when(F.size(texts) > 0, texts).alias("texts")).groupBy(key).agg(F.collect_list("number").alias("numbers"), F.flatten(F.collect_list("texts")).alias("texts"))
    forms = F.flatten(F.transform("numbers", lambda x: F.coalesce(number_form_columns(x), none)))
    return cases.select(key, F.explode(F.array_distinct(F.concat("texts", forms))).alias("token"))
