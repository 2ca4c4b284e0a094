"""What a failed generated test means, what a host compiles, what a proposal may run, and which repositories are pinned."""

from __future__ import annotations

import ast
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVALID = ["mem::zeroed", "mem::uninitialized", "MaybeUninit", "transmute", "ptr::null", "null_mut"]
DEFERRED = ["Completion", "Future", "JoinHandle", "Poll<", "BoxFuture", "LocalBoxFuture", "Receiver<", "oneshot::"]
CLOSED = ("target_os", "target_family", "target_arch", "target_env", "target_pointer_width", "target_vendor", "target_endian", "target_abi")
FORBIDDEN = {"__import__", "exec", "eval", "open", "compile", "input", "getattr"}
MOST_CHARS = 2000


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def failures(tests: DataFrame) -> DataFrame:
    """`tests` (body, return_type, message: that of the panic, NULL if none) with `bucket`.

    The last string of the body is the assertion's message: a panic that says it is a divergence, unless the result comes
    later than the return; any other panic is an invalid fixture if one is made up in the body, and else incidental."""
    strings = F.regexp_extract_all("body", F.lit(r'"((?:\\.|[^"\\])*)"'), 1)
    wanted, seen = F.trim(F.try_element_at(strings, F.lit(-1))), F.trim(F.col("message"))
    asserted = F.coalesce((wanted != "") & (seen.contains(wanted) | wanted.contains(seen)), F.lit(False))
    bucket = (
        F.when(asserted & _any(F.col("return_type"), DEFERRED), "wrong_channel").when(asserted, "divergence")
        .when(_any(F.col("body"), INVALID), "invalid_fixture").otherwise("incidental_panic")
    )
    return tests.withColumn("bucket", bucket)


def holds(predicate: str, host: frozenset[str]) -> bool | None:
    """Whether a host, given by its facts, compiles what a predicate guards: None where the facts don't say."""
    tokens = re.findall(r"[(),]|\b(?:all|any|not)\b(?=\s*\()|[A-Za-z_]\w*(?:\s*=\s*\"[^\"]*\")?", predicate)

    def term(i: int) -> tuple[bool | None, int]:
        if i >= len(tokens):
            return None, i
        if tokens[i] in ("all", "any", "not") and i + 1 < len(tokens) and tokens[i + 1] == "(":
            kind, values, i = tokens[i], [], i + 2
            while i < len(tokens) and tokens[i] != ")":
                value, i = term(i)
                values.append(value)
                i += i < len(tokens) and tokens[i] == ","
            if kind == "not":
                return (None if not values or values[0] is None else not values[0]), i + 1
            decisive = kind == "any"
            return (decisive if decisive in values else None if None in values else not decisive), i + 1
        fact = re.sub(r"\s*=\s*", "=", tokens[i])
        if fact in host:
            return True, i + 1
        key, _, value = fact.partition("=")
        known = any(h.startswith(key + "=") for h in host) if value else key in ("unix", "windows")
        return (False if known and (not value or key in CLOSED) else None), i + 1

    return term(0)[0]


def compiled(branches: DataFrame, facts: list[str]) -> DataFrame:
    """`branches` (cfg, …) with `compiled`: true, false or NULL where the host's facts don't say; true without a cfg."""
    host = frozenset(re.sub(r"\s*=\s*", "=", f.strip()) for f in facts if f.strip())

    @F.pandas_udf("boolean")
    def judge(cfg: pd.Series) -> pd.Series:
        known = {p: holds(p, host) for p in cfg.dropna().unique()}
        return cfg.map(lambda p: True if p is None or p == "" else known.get(p)).astype("object")

    return branches.withColumn("compiled", judge("cfg"))


def fault(given: str | None, expected: str | None, explanation: str | None) -> str:
    """What is wrong with a proposal, the empty string if nothing is: both codes must be expressions that reach nothing outside."""
    for name, form, text in (("concrete_input", "f({})", given), ("expected_property", "({})", expected)):
        text = text or ""
        if not text.strip():
            return f"{name} is empty"
        if len(text) > MOST_CHARS:
            return f"{name} is too long"
        try:
            tree = ast.parse(form.format(text), mode="eval")
        except (SyntaxError, ValueError, RecursionError):
            return f"{name} is no expression"
        if FORBIDDEN & {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}:
            return f"{name} reaches out"
    return "" if (explanation or "").strip() else "plain_explanation is empty"


def validated(proposals: DataFrame) -> DataFrame:
    """`proposals` (concrete_input, expected_property, plain_explanation) with `fault`."""

    @F.pandas_udf("string")
    def judge(given: pd.Series, expected: pd.Series, explanation: pd.Series) -> pd.Series:
        return pd.Series([fault(*row) for row in zip(given, expected, explanation, strict=True)], dtype="object")

    return proposals.withColumn("fault", judge("concrete_input", "expected_property", "plain_explanation"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(slug, lang, commit, license) of the repositories that a manifest of a few dozen rows pins."""
    with open(path, "rb") as f:
        rows = [tuple(r.get(k) for k in ("slug", "lang", "commit", "license")) for r in tomllib.load(f).get("repo", [])]
    return spark.createDataFrame(rows, "slug string, lang string, commit string, license string")
