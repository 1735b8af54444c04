"""Injection, personal-data and policy operators over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Injection patterns and their weights.
INJECTION = {
    "instruction_override": (r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|context|prompts?)", 0.9),
    "system_role_injection": (r"(?i)(you\s+are\s+now|act\s+as|pretend\s+(to\s+be|you\s+are)|new\s+instructions?:|system\s*:)", 0.8),
    "delimiter_injection": (r"(?i)(```\s*system|<\|im_start\|>|<\|endoftext\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)", 0.9),
    "output_manipulation": (r"(?i)(output\s*:|response\s*:|answer\s*:|reply\s+with\s*:)", 0.3),
    "data_exfiltration": (r"(?i)(repeat\s+(all|every)\s+(\w+\s+)*(text|content|instructions?|context)|what\s+(are|were)\s+your\s+(instructions?|rules?|system\s+prompt))", 0.7),
    "base64_payload": (r"[A-Za-z0-9+/]{60,}={1,2}", 0.4),
    "unicode_escape_injection": (r"(\\u[0-9a-fA-F]{4}){4,}", 0.5),
    "control_char_injection": (r"[\x0b\x0c\x1b\x7f]", 0.6),
    "bidi_override": (r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200e}\x{200f}]", 0.7),
    "path_traversal": (r"(\.\.[\\/]|\.\.%2[fF])", 0.8),
    "yaml_json_injection": (r"(?i)(!!python/|!!binary|!!map|__import__|yaml\.unsafe_load)", 0.8),
}
# Personal-data patterns.
PII = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "credit_card": r"\b(?:\d{4}[\s-]?){3}\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "phi": r"(?i)\b(?:MRN|DOB|NHS)[\s:]*[A-Z0-9-]+\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b",
    "passport": r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b",
}
# What replaces personal data, toxic phrases, markers of risky prompts and structural characters.
REDACTIONS = (("email", "[EMAIL]"), ("credit_card", "[CARD]"), ("ssn", "[SSN]"), ("phone", "[PHONE]"), ("phi", "[PHI]"))
TOXIC = ("go kill yourself", "kys", "worthless piece of", "i hate you", "nobody wants you", "you deserve to die", "die already")
MARKERS = (r"(?i)\bignore (?:all |the |your |previous )", r"(?i)\bSYSTEM\s*:", r"(?i)\[\s*system\s*\]", r"(?i)(?:you are|act as) (?:a|an) (?:admin|root|developer)", r"(?i)\bdelimiter\s+collision\b")
STRUCTURAL = "[]{}<>|`"
#: What a lower-cased text holds wherever a pattern matches: each pattern runs over the texts that hold one of these alone.
NEEDS = {
    "instruction_override": ("ignore",), "system_role_injection": ("you", "act", "pretend", "new", "system"), "delimiter_injection": ("```", "<|im_start|>", "<|endoftext|>", "inst]", "sys>>"),
    "output_manipulation": (":",), "data_exfiltration": ("repeat", "your"), "base64_payload": ("=",), "unicode_escape_injection": ("\\u",), "path_traversal": ("..",),
    "yaml_json_injection": ("!!", "__import__", "yaml.unsafe_load"), "email": ("@",), "ssn": ("-",), "phi": ("mrn", "dob", "nhs"), "ipv4": (".",),
}
MARKER_NEEDS = (("ignore ",), ("system",), ("system",), ("you are", "act as"), ("delimiter",))
#: Digits that a kind of personal data has at least.
LEAST_DIGITS = {"credit_card": 16, "ssn": 9, "phone": 10, "iban": 9, "passport": 7, "ipv4": 4}


def holds_any(low: Column, needs: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the strings."""
    out = F.lit(False)
    for n in needs:
        out = out | low.contains(n)
    return out


def matches(text: Column, low: Column, pattern: str, needs: tuple[str, ...]) -> Column:
    """``text.rlike(pattern)``, tried only where the text holds what every match needs."""
    return F.when(holds_any(low, needs), text.rlike(pattern)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def injection_score(df: DataFrame, column: str = "text", block: float = 0.8, longest: int = 100_000) -> DataFrame:
    """``suspicion`` (weights of the patterns found, at most 1; 1 for texts over ``longest``), ``found``, ``blocked``."""
    text = F.col(column)
    low = "lowered text"
    df = df.withColumn(low, F.lower(text))
    wide = F.octet_length(text) != F.char_length(text)
    seen = [matches(text, F.col(low), p, NEEDS[k]) if k in NEEDS else F.when(wide, text.rlike(p)).otherwise(False) if k == "bidi_override" else text.rlike(p) for k, (p, _) in INJECTION.items()]
    df = df.withColumn("found", F.array(*seen)).drop(low)  # each pattern runs once
    total = sum((F.when(F.col("found")[i], w).otherwise(0.0) for i, (_, w) in enumerate(INJECTION.values())), F.lit(0.0))
    df = df.withColumn("suspicion", F.when(F.char_length(text) > longest, 1.0).otherwise(F.least(total, F.lit(1.0))))
    names = F.array_compact(F.array(*[F.when(F.col("found")[i], F.lit(name)) for i, name in enumerate(INJECTION)]))
    return df.withColumn("found", names).withColumn("blocked", F.round("suspicion", 9) >= block)


def pii_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """A count for each kind of personal data, ``n_<kind>``."""
    text, low, digits = F.col(column), "lowered text", "number of digits"
    df = df.withColumns({low: F.lower(text), digits: F.char_length(text) - F.char_length(F.translate(text, "0123456789", ""))})

    def count(kind: str, pattern: str) -> Column:
        able = F.col(digits) >= LEAST_DIGITS.get(kind, 0)
        able = able & holds_any(F.col(low), NEEDS[kind]) if kind in NEEDS else able
        return F.when(able, F.size(T.find_all(text, pattern))).otherwise(0)

    return df.withColumns({f"n_{k}": count(k, p) for k, p in PII.items()}).drop(low, digits)


def redacted(text: Column) -> Column:
    """The text with five kinds of personal data replaced, in order."""
    for kind, label in REDACTIONS:
        text = F.regexp_replace(text, PII[kind], F.lit(label.replace("$", r"\$")))
    return text


def toxicity_hits(df: DataFrame, column: str = "text") -> DataFrame:
    """``toxic_hits``: seed phrases found as whole words, whatever their case."""
    text = F.lower(column)
    return df.withColumn("toxic_hits", F.array_compact(F.array(*[F.when(text.contains(k) & text.rlike(rf"\b{k}\b"), F.lit(k)) for k in TOXIC])))


def prompt_risk(df: DataFrame, column: str = "text", longest: int = 8000) -> DataFrame:
    """``risk``: max(0.4 length / longest, 0.7 min(1, 40 structural density), 0.35 marker hits); 0 for blank prompts."""
    text = F.col(column)
    n = F.char_length(text)
    density = (n - F.char_length(F.translate(text, STRUCTURAL, ""))) / F.greatest(n, F.lit(1))
    low = "lowered text"
    df = df.withColumn(low, F.lower(text))
    hits = sum((F.when(matches(text, F.col(low), p, needs), 1).otherwise(0) for p, needs in zip(MARKERS, MARKER_NEEDS, strict=True)), F.lit(0))
    risk = F.greatest(0.4 * F.least(n / longest, F.lit(1.0)), 0.7 * F.least(density * 40, F.lit(1.0)), F.least(hits * 0.35, F.lit(1.0)))
    return df.withColumn("risk", F.when(F.btrim(text, F.lit(" \t\n\r")) == "", 0.0).otherwise(F.least(risk, F.lit(1.0)))).drop(low)


def route(df: DataFrame, reject: float = 0.9, nli: float = 0.5, embed: float = 0.2) -> DataFrame:
    """``action`` by the risk's band: reject, nli, embed or rules."""
    return df.withColumn("action", F.when(F.col("risk") >= reject, "reject").when(F.col("risk") >= nli, "nli").when(F.col("risk") >= embed, "embed").otherwise("rules"))


def policy_violations(df: DataFrame, forbidden: tuple[str, ...], max_length: int, column: str = "text", key: str = "id") -> DataFrame:
    """One row per violation: ``id, rule, detail``."""
    text = F.col(column)
    found = F.array(
        *[F.when(F.lower(text).contains(p.lower()), F.struct(F.lit("forbidden").alias("rule"), F.lit(p).alias("detail"))) for p in forbidden],
        F.when(F.char_length(text) > max_length, F.struct(F.lit("max_length").alias("rule"), F.char_length(text).cast("string").alias("detail"))),
    )
    return df.select(F.col(key).alias("id"), F.explode(F.array_compact(found)).alias("v")).select("id", "v.rule", "v.detail")
