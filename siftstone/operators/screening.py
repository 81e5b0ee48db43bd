"""Text screening as projections: personal data, prompt injection, biased claims,
query safety, intents and conversation compaction. Regular expressions run in
the JVM over whole texts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import ref


def _java(pattern: str, ignore_case: bool = False) -> str:
    """Unicode classes, as the pattern's word and space classes are meant for any language."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def _any_of(parts: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in parts)


def _folded(text: Column) -> Column:
    """Lower case under which every letter the patterns accept in any case is its plain one."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.translate(text, "ſıİK", "siik")))


def _hinted(folded: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is there; one written with a leading ``^`` must not follow a letter or digit."""
    inside = [F.contains(folded, F.lit(w)) for w in words if not w.startswith("^")]
    begins = [F.contains(folded, F.lit(w[1:])) & folded.rlike(f"(?<![a-z0-9_]){w[1:]}") for w in words if w.startswith("^")]
    return reduce(lambda a, b: a | b, inside + begins)


# ── personal data ───────────────────────────────────────────────────────────


def detect_pii(df: DataFrame, text: str, redact: bool = True) -> DataFrame:
    """Adds the personal-data columns. Each pattern is tested once per row."""
    flagged = _pii_flags(df, ref(text))
    if redact:
        flagged = _redact(flagged, ref(text))
    return _pii_summary(flagged).drop(*[f"_hit_{name}" for name, _ in fixed.PII_PATTERNS])


def _pii_flags(df, text):
    """One boolean per category; a cheap necessary condition runs before each pattern."""
    df = df.withColumns(
        {
            "_digit": F.coalesce(text.rlike(r"\p{Nd}"), F.lit(False)),
            "_digits": F.coalesce(text.rlike(r"\p{Nd}{3}"), F.lit(False)),
        }
    )
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    needed = {
        "email": has("@"),
        "phone_us": F.col("_digits"),
        "phone_intl": F.col("_digit") & has("+"),
        "ssn": F.col("_digits"),
        "credit_card": F.col("_digits"),
        "ipv4": F.col("_digit") & has("."),
        "ipv6": has(":"),
        "name_title": has("Mr", "Ms", "Dr", "Prof"),
        "street_addr": F.col("_digit"),
        "passport": F.col("_digits"),
    }
    return df.withColumns(
        {
            f"_hit_{name}": F.coalesce(needed[name] & text.rlike(_java(p)), F.lit(False))
            for name, p in fixed.PII_PATTERNS
        }
    ).drop("_digit", "_digits")


def _redact(df, text):
    """Redactions in list order, only for the categories found in the original text."""
    df = df.withColumn("redacted", text)
    for name, pattern in fixed.PII_PATTERNS:
        replaced = F.regexp_replace("redacted", _java(pattern), f"[{name.upper()}_REDACTED]")
        df = df.withColumn("redacted", F.when(F.col(f"_hit_{name}"), replaced).otherwise(F.col("redacted")))
    return df


def _pii_summary(df):
    found = F.array_compact(
        F.array(*[F.when(F.col(f"_hit_{name}"), F.lit(name)) for name, _ in fixed.PII_PATTERNS])
    )
    return df.withColumn("pii_categories", found).withColumns(
        {
            "pii_detected": F.size("pii_categories") > 0,
            "pii_score": F.round(F.size("pii_categories") / F.lit(len(fixed.PII_PATTERNS)), 4),
        }
    )


# ── prompt injection ────────────────────────────────────────────────────────


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 1.0, "critical")
        .when(score >= 0.7, "high")
        .when(score >= 0.4, "medium")
        .when(score >= 0.2, "low")
        .otherwise("none")
    )


def score_injection(df: DataFrame, text: str, min_score: float = 0.4) -> DataFrame:
    """Adds ``injection_patterns, injection_score, injection_risk, injection_detected``.

    Each category counts once per text; texts under five characters are safe.
    """
    long_enough = F.coalesce(F.length(ref(text)) >= 5, F.lit(False))
    flagged = df.withColumn("_folded", _folded(ref(text))).withColumns(
        {
            f"_inj_{name}": long_enough
            & _hinted(F.col("_folded"), fixed.INJECTION_HINTS[name])
            & ref(text).rlike(_java(_any_of(patterns), ignore_case=True))
            for name, _, patterns in fixed.INJECTION_PATTERNS
        }
    ).drop("_folded")
    weight = F.lit(0.0)
    for name, points, _ in fixed.INJECTION_PATTERNS:
        weight = weight + F.when(F.col(f"_inj_{name}"), points).otherwise(0.0)
    found = F.array_compact(
        F.array(*[F.when(F.col(f"_inj_{name}"), F.lit(name)) for name, _, _ in fixed.INJECTION_PATTERNS])
    )
    scored = flagged.withColumn(
        "injection_score", F.least(F.lit(1.0), F.round(weight / fixed.INJECTION_TOTAL, 4))
    ).withColumn("injection_patterns", found)
    return scored.withColumns(
        {
            "injection_risk": risk_level(F.col("injection_score")),
            "injection_detected": F.col("injection_score") >= min_score,
        }
    ).drop(*[f"_inj_{name}" for name, _, _ in fixed.INJECTION_PATTERNS])


# ── governance ──────────────────────────────────────────────────────────────


def govern_input(
    df: DataFrame, text: str, policy: str = "moderate", check_pii: bool = True, check_injection: bool = True
) -> DataFrame:
    """allow, sanitise or block each message, with reason and audit fields."""
    if policy not in ("strict", "moderate", "permissive"):
        raise ValueError(f"unknown policy: {policy!r}")
    out = df
    if check_injection:
        out = score_injection(out, text)
    else:
        out = out.withColumns(
            {
                "injection_patterns": F.array().cast("array<string>"),
                "injection_score": F.lit(0.0),
                "injection_risk": F.lit("none"),
                "injection_detected": F.lit(False),
            }
        )
    if check_pii:
        out = detect_pii(out, text)
    else:
        out = out.withColumns(
            {
                "pii_categories": F.array().cast("array<string>"),
                "pii_detected": F.lit(False),
                "pii_score": F.lit(0.0),
                "redacted": ref(text),
            }
        )
    risk = F.col("injection_risk")
    if policy == "permissive":
        action, reason = F.lit("allow"), F.lit("")
    else:
        strict = policy == "strict"
        categories = F.concat_ws(", ", "pii_categories")
        action = (
            F.when(risk.isin("high", "critical"), "block")
            .when(risk == "medium", "block" if strict else "sanitise")
            .when(F.col("pii_detected"), "block" if strict else "sanitise")
            .otherwise("allow")
        )
        reason = (
            F.when(
                risk.isin("high", "critical"),
                F.concat(
                    F.lit("Prompt injection detected (risk="), risk, F.lit(", patterns="),
                    F.concat_ws(", ", "injection_patterns"), F.lit("). Request blocked."),
                ),
            )
            .when(
                risk == "medium",
                "Possible injection (STRICT policy). Request blocked."
                if strict
                else "Possible injection; message sanitised.",
            )
            .when(
                F.col("pii_detected"),
                F.concat(F.lit("PII detected ("), categories, F.lit("). Request blocked under STRICT policy."))
                if strict
                else F.concat(F.lit("PII sanitised ("), categories, F.lit(").")),
            )
            .otherwise("")
        )
    return out.withColumns(
        {
            "policy": F.lit(policy),
            "action": action,
            "block_reason": reason,
            "safe_message": F.col("redacted"),
            "message_length": F.coalesce(F.length(ref(text)), F.lit(0)),
        }
    ).drop("redacted")


def govern_output(df: DataFrame, text: str) -> DataFrame:
    """Leaked personal data in an answer is redacted; nothing is blocked."""
    return detect_pii(df, text).withColumns(
        {
            "action": F.when(F.col("pii_detected"), "sanitise").otherwise("allow"),
            "block_reason": F.when(
                F.col("pii_detected"), "PII detected in agent output; content sanitised."
            ).otherwise(""),
            "safe_message": F.col("redacted"),
        }
    ).drop("redacted")


# ── biased language ─────────────────────────────────────────────────────────


def bias_matches(text: Column) -> Column:
    """Array of (bias_type, severity, matched, suggestion), one per match."""
    def flagged(name, severity, suggestion):
        return lambda m: F.struct(
            F.lit(name).alias("bias_type"),
            F.lit(severity).alias("severity"),
            m.alias("matched"),
            F.lit(suggestion).alias("suggestion"),
        )

    parts = [
        F.transform(
            F.regexp_extract_all(text, F.lit(_java(pattern, ignore_case=True)), F.lit(0)),
            flagged(name, severity, suggestion),
        )
        for name, severity, suggestion, patterns in fixed.BIAS_PATTERNS
        for pattern in patterns
    ]
    return F.flatten(F.array(*parts))


def bias_flags(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per biased expression."""
    return df.select(*[ref(k) for k in keys], F.inline(bias_matches(ref(text))))


def score_bias(df: DataFrame, text: str) -> DataFrame:
    """Adds ``bias_counts``-based ``bias_score`` (0 to 1), ``bias_flag_count`` and ``is_biased``."""
    counts = {}
    for name, _, _, patterns in fixed.BIAS_PATTERNS:
        total = F.lit(0)
        for pattern in patterns:
            total = total + F.regexp_count(ref(text), F.lit(_java(pattern, ignore_case=True)))
        counts[f"_bias_{name}"] = F.when(
            _hinted(F.col("_folded"), fixed.BIAS_HINTS[name]), F.coalesce(total, F.lit(0))
        ).otherwise(0)
    counted = df.withColumn("_folded", _folded(ref(text))).withColumns(counts).drop("_folded")
    weight, flags, serious = F.lit(0.0), F.lit(0), F.lit(False)
    for name, severity, _, _ in fixed.BIAS_PATTERNS:
        n = F.col(f"_bias_{name}")
        weight = weight + n * F.lit(fixed.BIAS_WEIGHTS[severity])
        flags = flags + n
        if severity in ("medium", "high"):
            serious = serious | (n > 0)
    return counted.withColumns(
        {
            "bias_flag_count": flags,
            "bias_score": F.least(F.lit(1.0), F.round(weight / 3, 4)),
            "is_biased": serious,
        }
    ).drop(*counts)


# ── claim checks ────────────────────────────────────────────────────────────

# Claim patterns.
RANGE_CLAIM = r"\b(\w[\w\s]*?)\s+(?:is|of|at|was|equals?)\s+\$?([\d,]+\.?\d*)\b"
PERCENT_CLAIM = r"\b([\d,]+\.?\d*)\s*%"
NEGATIVE_COUNT_CLAIM = r"\b(?:count|total|number\s+of|sum\s+of|quantity\s+of)\b.{0,30}-(\d+)\b"


def sentences(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    parts = F.split(ref(text), r"(?U)(?<=[.!?])\s+")
    return df.select(
        *[ref(k) for k in keys], F.posexplode(parts).alias("sentence_no", "sentence")
    )


def _as_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def claim_issues(df: DataFrame, keys: Sequence[str], text: str, profile: DataFrame | None = None) -> DataFrame:
    """Claims that contradict the column profile or are impossible in themselves.

    ``profile`` needs ``column_name, min_val, max_val`` and optionally
    ``ordinal``. A range claim belongs to the first column (by ordinal, then
    name) whose name contains, or is contained in, the claim's subject. The
    profile, one row per column of a table, is a scalar of the plan; the texts are
    read and split once, and each sentence lists its issues.
    """
    sentence = F.col("sentence")

    def issue(kind, severity, expected, actual):
        return F.struct(
            F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), expected.alias("expected"), actual.alias("actual")
        )

    shares = F.regexp_extract_all(sentence, F.lit(_java(PERCENT_CLAIM)), F.lit(1))
    impossible = F.filter(shares, lambda raw: (_as_number(raw) < 0) | (_as_number(raw) > 100))
    counts = F.regexp_extract_all(sentence, F.lit(_java(NEGATIVE_COUNT_CLAIM, ignore_case=True)), F.lit(1))
    found = [
        F.transform(impossible, lambda raw: issue("percentage", "high", F.lit("0% to 100%"), F.concat(raw, F.lit("%")))),
        F.transform(counts, lambda raw: issue("count", "medium", F.lit("non-negative integer"), F.concat(F.lit("-"), raw))),
    ]
    if profile is not None:
        ordinal = F.col("ordinal") if "ordinal" in profile.columns else F.lit(0)
        row = F.struct(ordinal.alias("ordinal"), "column_name", F.lower("column_name").alias("name"), "min_val", "max_val")
        known = profile.agg(F.sort_array(F.collect_list(row))).scalar()
        lowered = F.lower(sentence)
        claims = F.arrays_zip(
            F.regexp_extract_all(lowered, F.lit(_java(RANGE_CLAIM)), F.lit(1)).alias("subject"),
            F.regexp_extract_all(lowered, F.lit(_java(RANGE_CLAIM)), F.lit(2)).alias("raw"),
        )

        def bounded(claim):
            subject = F.trim(claim["subject"])
            own = F.get(F.filter(F.col("_known"), lambda c: F.contains(subject, c["name"]) | F.contains(c["name"], subject)), F.lit(0))
            return F.struct(claim["raw"].alias("raw"), own["min_val"].alias("low"), own["max_val"].alias("high"))

        beyond = F.filter(F.transform(claims, bounded), lambda c: (_as_number(c["raw"]) < c["low"]) | (_as_number(c["raw"]) > c["high"]))
        between = lambda c: F.concat(F.lit("between "), c["low"].cast("string"), F.lit(" and "), c["high"].cast("string"))
        found.append(F.transform(beyond, lambda c: issue("range", "high", between(c), c["raw"])))
    parts = sentences(df, keys, text)
    parts = parts if profile is None else parts.withColumn("_known", known)
    listed = parts.select(*[ref(k) for k in keys], "sentence_no", "sentence", F.explode(F.concat(*found)).alias("_i"))
    return listed.select(*[ref(k) for k in keys], "sentence_no", "sentence", "_i.*")


def validate_responses(
    df: DataFrame, keys: Sequence[str], text: str, profile: DataFrame | None = None
) -> DataFrame:
    """Verdict per answer: no high-severity issue and a bias score below 0.40.

    An answer that fails carries the note.
    """
    found = claim_issues(df, keys, text, profile)
    counted = found.groupBy(*[ref(k) for k in keys]).agg(
        F.count("*").alias("claim_issues"), F.count_if(F.col("severity") == "high").alias("_high")
    )
    causal = next(p for name, _, _, p in fixed.BIAS_PATTERNS if name == "causation_from_correlation")
    is_causal = F.coalesce(ref(text).rlike(_java(_any_of(causal), ignore_case=True)), F.lit(False))
    scored = score_bias(df, text).withColumn("_causal", is_causal).join(counted, list(keys), "left")
    high = F.coalesce(F.col("_high"), F.lit(0))
    valid = (high == 0) & ~F.col("_causal") & (F.col("bias_score") < fixed.BIAS_LIMIT)
    return (
        scored.withColumn("claim_issues", F.coalesce("claim_issues", F.lit(0)))
        .withColumn("is_valid", valid)
        .withColumn(
            "validated_response",
            F.when(F.col("is_valid"), ref(text)).otherwise(
                F.concat(ref(text), F.lit(fixed.VALIDATION_NOTE))
            ),
        )
        .drop("_high", "_causal")
    )


# ── query safety ────────────────────────────────────────────────────────────

def sql_verdict(sql: Column) -> dict[str, Column]:
    """``cleaned`` and ``reject_reason`` (null when safe) for a column of query texts."""
    trimmed = F.regexp_replace(sql, r"^\s+|\s+$", "")
    fenced = F.concat_ws(
        "\n", F.filter(F.split(trimmed, "\r?\n"), lambda line: ~line.startswith("```"))
    )
    body = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    body = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r";+$", "")
    body = F.regexp_replace(body, r"\s+$", "")
    upper = F.upper(body)
    words = r"\b(" + "|".join(fixed.BLOCKED_SQL_WORDS) + r")\b"
    functions = r"\b(" + "|".join(fixed.BLOCKED_SQL_FUNCTIONS) + r")\s*\("
    reason = (
        F.when(sql.isNull() | (trimmed == ""), "empty")
        .when(~upper.startswith("SELECT"), "not a select")
        .when(upper.rlike(words), "blocked keyword")
        .when(upper.rlike(functions), "blocked function")
        .when(F.contains(body, F.lit("--")) | F.contains(body, F.lit("/*")), "comment")
        .when(F.contains(body, F.lit(";")), "multiple statements")
    )
    return {"cleaned": body, "reject_reason": reason}


def screen_sql(df: DataFrame, sql: str) -> DataFrame:
    verdict = sql_verdict(ref(sql))
    return df.withColumns(verdict).withColumn("is_safe", F.col("reject_reason").isNull())


# ── intents, insights, conversations ────────────────────────────────────────


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(_any_of([re.escape(w) for w in words]))


def classify_intent(df: DataFrame, text: str) -> DataFrame:
    """Adds intent, confidence and routing flags; null where no word is found."""
    lowered = F.lower(ref(text))
    which = F.lit(-1)
    for i, (_, _, words, _) in reversed(list(enumerate(fixed.INTENTS))):
        which = F.when(_contains_any(lowered, words), i).otherwise(which)
    out = df.withColumn("_which", which)

    def by_intent(values):
        picked = F.when(F.col("_which") == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            picked = picked.when(F.col("_which") == i, value)
        return picked

    columns = {
        "intent": by_intent([name for name, _, _, _ in fixed.INTENTS]),
        "confidence": by_intent([c for _, c, _, _ in fixed.INTENTS]),
    }
    for flag in ("requires_sql", "requires_rag", "requires_forecast", "requires_viz"):
        columns[flag] = by_intent([flags[flag] for _, _, _, flags in fixed.INTENTS])
    return out.withColumns(columns).drop("_which")


def score_insights(df: DataFrame, headline: str, explanation: str, columns: Sequence[str]) -> DataFrame:
    """Five-criterion rubric of an insight text; passes at 0.75 overall and accuracy above 0."""
    text = F.lower(F.concat_ws(" ", F.coalesce(ref(headline), F.lit("")), F.coalesce(ref(explanation), F.lit(""))))
    number = text.rlike(r"\d+[%$.,]?\d*")
    named = _contains_any(text, [c.lower() for c in columns])
    what, why = _contains_any(text, fixed.WHAT_WORDS), _contains_any(text, fixed.WHY_WORDS)
    scored = df.withColumns(
        {
            "accuracy": F.when(number & named, 1.0).when(named, 0.5).otherwise(0.0),
            "specificity": F.when(_contains_any(text, fixed.VAGUE_WORDS), 0.0).otherwise(1.0),
            "relevance": F.when(_contains_any(text, fixed.ACTION_WORDS), 1.0).otherwise(0.5),
            "completeness": F.when(what & why, 1.0).when(what | why, 0.5).otherwise(0.0),
            "bias": F.when(_contains_any(text, fixed.ABSOLUTE_WORDS), 0.0).otherwise(1.0),
        }
    )
    total = sum((F.col(c) for c in ("specificity", "relevance", "completeness", "bias")), F.col("accuracy"))
    return scored.withColumn("overall", F.round(total / 5, 3)).withColumn(
        "passes", (F.col("overall") >= 0.75) & (F.col("accuracy") > 0)
    )


def last_turns(df: DataFrame, conversation: str, turn: str, keep: int = 4) -> DataFrame:
    """The last ``keep`` turns per conversation; the rank limit applies before the shuffle."""
    order = Window.partitionBy(ref(conversation)).orderBy(ref(turn).desc())
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def compact_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trigger: int = 10,
    keep: int = 4,
) -> DataFrame:
    """Long conversations become summary, acknowledgement and the last turns.

    ``position`` orders the result: 0 and 1 are the two new rows, the others
    keep ``turn + 2``. Turns are counted per conversation by an aggregate, so
    a very long conversation is never gathered in one task.
    """
    lengths = df.groupBy(ref(conversation).alias("_conv")).agg(F.count("*").alias("_n"))
    long = lengths.where(F.col("_n") >= trigger)
    tail = last_turns(df, conversation, turn, keep)
    shape = [ref(conversation), ref(role), ref(text)]
    kept = tail.join(long, ref(conversation) == F.col("_conv"), "left_semi").select(
        *shape, (ref(turn) + 2).cast("long").alias("position")
    )
    short = df.join(long, ref(conversation) == F.col("_conv"), "left_anti").select(
        *shape, (ref(turn) + 2).cast("long").alias("position")
    )
    placeholder = F.concat(
        F.lit("[Context from prior conversation]\n[Prior conversation: "),
        (F.col("_n") - keep).cast("string"),
        F.lit(" turns about this dataset were summarised here.]"),
    )
    new = long.select(
        F.col("_conv").alias(conversation),
        F.explode(
            F.array(
                F.struct(F.lit("user").alias(role), placeholder.alias(text), F.lit(0).cast("long").alias("position")),
                F.struct(
                    F.lit("assistant").alias(role),
                    F.lit("Understood. I have the context from our earlier discussion.").alias(text),
                    F.lit(1).cast("long").alias("position"),
                ),
            )
        ).alias("m"),
    ).select(conversation, "m.*")
    return short.unionByName(kept).unionByName(new)


def search_conversations(
    df: DataFrame,
    needle: str,
    conversation: str = "conv_id",
    text: str = "text",
    recency: str = "turn",
    limit: int | None = None,
) -> DataFrame:
    """Conversations that contain the words (any case), most recent first."""
    hits = df.where(F.contains(F.lower(ref(text)), F.lit(needle.lower())))
    matched = hits.select(ref(conversation)).distinct()
    latest = df.groupBy(ref(conversation)).agg(F.max(ref(recency)).alias("last_update"))
    found = latest.join(matched, conversation, "left_semi").orderBy(F.desc("last_update"), ref(conversation))
    return found if limit is None else found.limit(limit)
