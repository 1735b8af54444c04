"""Checks of structured and numeric output."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def json_check(rows: DataFrame, required: tuple[str, ...], column: str = "props") -> DataFrame:
    """``valid_json``, ``missing`` required keys, ``k_is_integer``: parsed natively, never by row-wise Python."""
    parsed = F.try_parse_json(F.col(column))
    keys = F.array_compact(F.array(*[F.when(F.get_json_object(column, f"$.{k}").isNull(), F.lit(k)) for k in required]))
    return rows.withColumns({"valid_json": parsed.isNotNull(), "missing": F.size(keys), "k_is_integer": F.coalesce(F.get_json_object(column, "$.k").rlike(r"^-?\d+$"), F.lit(False))})


# The patterns of numeric claims.
PERCENT_CHANGE = (
    r"(?i)(?:grew|increased|decreased|dropped|rose|fell|declined|changed|gained|lost)\s+(?:by\s+)?(\d{1,10}(?:\.\d{1,10})?)\s*%"
    r".{0,80}?\b(?:from|of)\s+\$?([\d,]{1,20}(?:\.\d{1,10})?)\s*(?:million|billion|thousand|[MBKmk])?"
    r".{0,80}?\bto\s+\$?([\d,]{1,20}(?:\.\d{1,10})?)\s*(?:million|billion|thousand|[MBKmk])?"
)
YEAR = r"\b((?:1[0-9]|20)\d{2})\b"
CHANCE = r"(?i)(-?\d{1,10}(?:\.\d{1,10})?)\s*(?:%|percent)\s+(?:probability|chance|likelihood|confidence)"
BORN, DIED, FOUNDED = (rf"{verb}\s+(?:in\s+)?(\d{{4}})" for verb in ("born", "died", "founded"))
EARTH = r"(?i)earth.*?population.*?(\d+(?:\.\d+)?)\s*(billion|million)"
LIGHT = r"(?i)speed\s+of\s+light.*?(\d+(?:,\d+)*(?:\.\d+)?)\s*(km/s|m/s)"
TOTAL = r"(?i)total\s+(?:of\s+)?(\d+(?:,\d+)*(?:\.\d+)?)"
NUMBER = r"(?i)(?<!\w)(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(million|billion|trillion|thousand|percent|%|km|mi|kg|lb|m|ft)?(?!\w)"
# The patterns of reasoning steps, tried in this order, and of conclusions.
STEPS = (
    (r"(?s)(?:^|\n)\s*(?:Step\s+)?(\d+)[.):]\s*(.+?)(?=\n\s*(?:Step\s+)?\d+[.):]+|\z)", 2),
    (r"(?s)(?:^|\n)\s*[-*]\s+(.+?)(?=\n\s*[-*]|\z)", 1),
    (r"(?si)(?:^|\n)(?:First|Second|Third|Next|Then|Finally|Therefore|Thus|Hence|So),?\s+(.+?)(?=\n(?:First|Second|Third|Next|Then|Finally|Therefore|Thus|Hence|So)|\z)", 1),
)
STEP_LABEL = r"(?i)^\s*(?:Step\s+)?\d+[.:)]\s*"
CONCLUSION = r"(?i)^(?:therefore|thus|hence|so|consequently|as a result|in conclusion|this means|it follows|we can conclude)"
PUNCTUATION = ".,;:!?\"'()[]"


def _groups(text: Column, pattern: str, group: int = 1) -> Column:
    """The numbers that a group of a pattern matches, without thousands separators; unreadable ones are null."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def numeric_claims(df: DataFrame, current_year: int, column: str = "text") -> DataFrame:
    """Adds the numeric issues of a text, counted by kind, ``n_claims`` and ``valid`` (no error; null texts are empty).

    Errors: ``bad_change`` (a stated percentage off by more than a point from its two amounts), ``bad_order`` (deaths before
    births, by pairs, and foundings after ``current_year``), ``bad_probability`` (below 0 or above 100), ``bad_total``
    (totals that differ from the first by over 1 %). Warnings: ``far_future`` (years more than 5 ahead) and
    ``bad_magnitude`` (population of the earth, speed of light).
    """
    text = F.coalesce(F.col(column), F.lit(""))
    change, before, after = (_groups(text, PERCENT_CHANGE, k) for k in (1, 2, 3))
    amounts = F.zip_with(before, after, lambda a, b: F.when(a > 0, F.abs(b - a) / a * 100))
    years = _groups(text, YEAR)
    chances, totals = _groups(text, CHANCE), _groups(text, TOTAL)
    born, died, founded = (_groups(F.lower(text), p) for p in (BORN, DIED, FOUNDED))
    deaths = F.aggregate(F.transform(born, lambda b: F.size(F.filter(died, lambda d: d < b))), F.lit(0), lambda acc, n: acc + n)
    people, light = (F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double") for p in (EARTH, LIGHT))
    people = F.when(F.lower(F.regexp_extract(text, EARTH, 2)) == "million", people / 1000).otherwise(people)
    first = F.try_element_at(totals, F.lit(1))
    out = df.withColumns({
        "bad_change": F.size(F.filter(F.zip_with(amounts, change, lambda real, said: F.abs(real - said) > 1.0), lambda x: x)),
        "far_future": F.size(F.filter(years, lambda y: y > current_year + 5)),
        "bad_order": deaths + F.size(F.filter(founded, lambda y: y > current_year)),
        "bad_probability": F.size(F.filter(chances, lambda x: (x > 100) | (x < 0))),
        "bad_magnitude": F.coalesce(((people < 6) | (people > 12)).cast("int"), F.lit(0)) + F.coalesce(((light < 200_000) | (light > 400_000)).cast("int"), F.lit(0)),
        "bad_total": F.size(F.filter(totals, lambda t: F.abs(t - first) > 0.01 * F.greatest(first, F.lit(1.0)))),
        "n_claims": F.size(change) + F.size(years) + F.size(chances) + F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))),
    })
    return out.withColumn("valid", F.col("bad_change") + F.col("bad_order") + F.col("bad_probability") + F.col("bad_total") == 0)


def reasoning_steps(text: Column) -> Column:
    """The steps of a chain of thought as an array: numbered, else bulleted, else introduced by first, then, so and the like.

    Two steps at least make a chain; without such marks the sentences of more than ten characters do. Labels go.
    """

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, STEP_LABEL, ""), r"^\s+|\s+$", "")

    marked = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda x: bare(F.regexp_replace(x, r"^\s+|\s+$", ""))) for p, g in STEPS]
    pieces = F.transform(F.split(text, r"[.!?]\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    plain = F.transform(F.filter(pieces, lambda x: F.char_length(x) > 10), bare)
    out = F.lit(None).cast("array<string>")
    for steps in (plain, *reversed(marked)):
        out = F.when(F.size(steps) >= 2, steps).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def conclusions(steps: Column) -> Column:
    """How many steps begin as a conclusion."""
    return F.size(F.filter(steps, lambda x: x.rlike(CONCLUSION)))


def step_words(text: Column) -> Column:
    """The set of lower-cased pieces between white space, without punctuation at their ends."""
    pieces = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.btrim(x, F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(pieces, lambda x: x != ""))


def reasoning_chain(steps: DataFrame) -> DataFrame:
    """Verdict of each step against all earlier ones of its chain: ``chain, step, best, verdict``.

    ``best`` is the largest overlap (Jaccard of ``step_words``) with an earlier step. Circular above 0.85, supported at a
    divergence of 0.3 or less, unsupported_leap at a support below 0.1, else non_sequitur; a first step is supported.
    Chains of one step have no verdict. Null texts have no words.
    """
    s = steps.select("chain", "step", step_words(F.coalesce("text", F.lit(""))).alias("w"))
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.chain") == F.col("b.chain")) & (F.col("b.step") < F.col("a.step")), "left")
    best = pairs.groupBy(F.col("a.chain").alias("chain"), F.col("a.step").alias("step")).agg(F.max(T.jaccard(F.col("a.w"), F.col("b.w"))).alias("best"), F.count("b.step").alias("earlier"))
    long = best.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("chain")
    divergence = 1 - F.coalesce("best", F.lit(0.0))
    verdict = F.when(F.col("earlier") == 0, "supported").when(F.col("best") > 0.85, "circular").when(divergence <= 0.3, "supported").when(1 - divergence < 0.1, "unsupported_leap").otherwise("non_sequitur")
    return best.join(long, "chain", "left_semi").select("chain", "step", F.when(F.col("earlier") > 0, F.round("best", 9)).alias("best"), verdict.alias("verdict"))


#: JSON Schema types by what ``schema_of_variant`` calls a value.
JSON_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "null": ("VOID",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _has_type(kind: Column, wanted: str) -> Column:
    names = JSON_TYPES.get(wanted)
    return F.lit(True) if names is None else kind.rlike("^(" + "|".join(names) + r")\b")


def json_schema(rows: DataFrame, schema: dict, column: str = "props") -> DataFrame:
    """Adds ``valid_json, schema_valid`` (null if it does not parse) and the counts ``n_missing, n_wrong_type, n_extra,
    n_bad_value`` of a JSON text against a schema.

    Types, required and additional properties are checked at every level of nested objects, ``enum`` and ``const`` at
    the root. Null texts do not parse. All runs on Spark's variant type.
    """
    parsed = F.try_parse_json(F.col(column))

    def at(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))

    def level(part: dict, path: str) -> tuple[list[Column], list[Column], list[Column]]:
        known = part.get("properties", {})
        keys = F.json_object_keys(F.col(column) if path == "$" else F.get_json_object(column, path))
        here = F.coalesce(keys, F.array().cast("array<string>"))
        is_object = keys.isNotNull()
        missing = [(is_object & ~F.array_contains(here, k)).cast("int") for k in part.get("required", [])]
        extra = [F.when(is_object, F.size(F.array_except(here, F.array(*[F.lit(k) for k in known]).cast("array<string>")))).otherwise(0)] if not part.get("additionalProperties", True) else []
        wrong = []
        for name, sub in known.items():
            own = f"{path}.{name}"
            if sub.get("type"):
                wrong.append((F.array_contains(here, name) & ~F.coalesce(_has_type(at(own), sub["type"]), F.lit(False))).cast("int"))
            if sub.get("type") == "object":
                m, w, e = level(sub, own)
                missing, wrong, extra = missing + m, wrong + w, extra + e
        return missing, wrong, extra

    root = F.lit(True) if "type" not in schema else F.coalesce(_has_type(F.schema_of_variant(parsed), schema["type"]), F.lit(False))
    missing, wrong, extra = level(schema, "$") if schema.get("type") == "object" else ([], [], [])
    total = lambda cols: sum(cols, F.lit(0))
    text = F.to_json(parsed)
    allowed = [F.lit(json.dumps(v, separators=(",", ":"))) for v in schema.get("enum", [])]
    bad = (~text.isin(*allowed)).cast("int") if allowed else F.lit(0)
    bad = bad + ((text != json.dumps(schema["const"], separators=(",", ":"))).cast("int") if "const" in schema else F.lit(0))
    out = rows.withColumns({"valid_json": parsed.isNotNull(), "n_missing": total(missing), "n_wrong_type": total(wrong) + (parsed.isNotNull() & ~root).cast("int"), "n_extra": total(extra), "n_bad_value": F.coalesce(bad, F.lit(0))})
    fine = (F.col("n_missing") + F.col("n_wrong_type") + F.col("n_extra") + F.col("n_bad_value")) == 0
    return out.withColumn("schema_valid", F.when(F.col("valid_json"), fine))


def tool_calls(calls: DataFrame, manifest: DataFrame, log: DataFrame) -> DataFrame:
    """Calls (``call_id, name, arguments map<string,string>, result``) against a manifest and an execution log.

    manifest: ``name, parameter, required, pattern`` (one row for each parameter; null parameter: none; ``pattern`` is
    what a value of its type looks like as text). log: ``name, arguments, result``. Returns ``call_id, name, known,
    n_missing, n_wrong_type, n_extra, arguments_valid, executed`` (the function has an entry), ``same_arguments`` and
    ``fabricated``: no entry of the function, or one with these arguments whose result is not the claimed one.
    """
    spec = manifest.groupBy(F.col("name").alias("m_name")).agg(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("parameter", "required", "pattern"))).alias("spec"))
    canonical = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    entries = log.select(F.col("name").alias("e_name"), canonical(F.col("arguments")).alias("e_arguments"), "result")
    entries = entries.groupBy("e_name", "e_arguments").agg(F.min_by("result", "result").alias("e_result"))
    ran = entries.select(F.col("e_name").alias("x_name")).distinct()
    c = calls.withColumn("key", canonical(F.col("arguments")))
    out = c.join(spec, c["name"] == spec["m_name"], "left").join(ran, c["name"] == ran["x_name"], "left").join(entries, (c["name"] == entries["e_name"]) & (c["key"] == entries["e_arguments"]), "left")
    given, wanted = F.map_keys("arguments"), F.coalesce(F.transform("spec", lambda p: p["parameter"]), F.array().cast("array<string>"))
    missing = F.size(F.filter("spec", lambda p: p["required"] & ~F.array_contains(given, p["parameter"])))
    wrong = F.size(F.filter("spec", lambda p: F.array_contains(given, p["parameter"]) & p["pattern"].isNotNull() & ~F.coalesce(F.regexp_like(F.element_at("arguments", p["parameter"]), p["pattern"]), F.lit(False))))
    known = F.col("m_name").isNotNull()
    counts = {"n_missing": missing, "n_wrong_type": wrong, "n_extra": F.size(F.array_except(given, wanted))}
    out = out.withColumns({k: F.when(known, v).otherwise(0) for k, v in counts.items()})
    same = F.col("e_name").isNotNull()
    return out.select("call_id", "name", known.alias("known"), *counts, (F.col("n_missing") + F.col("n_wrong_type") == 0).alias("arguments_valid"), F.col("x_name").isNotNull().alias("executed"), same.alias("same_arguments"), (F.col("x_name").isNull() | (same & (F.coalesce(calls["result"], F.lit("")) != "") & ~F.col("e_result").eqNullSafe(calls["result"]))).alias("fabricated"))
