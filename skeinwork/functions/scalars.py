"""Scalar functions (C1-C21), all inside Catalyst but for the driver-side configuration helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.tables import lookup


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x: Column, places: int = 0) -> Column:
    """Rounding with ties to even, of the scaled value: 0.125 gives 0.12 and 0.545 gives 0.55."""
    unit = F.lit(float(10**places))
    return F.rint(x.cast("double") * unit) / unit


def token_estimate(text: Column | str) -> Column:
    """Code points over four, rounded up; null counts as empty."""
    return F.floor((F.coalesce(F.length(_c(text)), F.lit(0)) + 3) / 4).cast("long")


def message_tokens(messages: Column | str) -> Column:
    """Sum over an array of texts."""
    return F.aggregate(_c(messages), F.lit(0).cast("long"), lambda a, x: a + token_estimate(x))


def raw_tokens(type_: Column | str, size: Column | str, fallback: Column | str, source: Column | str | None = None) -> Column:
    """A File costs its source if that is given, else at least its size over four; other nodes the fallback."""
    by_size = F.greatest(_c(fallback), F.floor((F.coalesce(_c(size), F.lit(0)) + 3) / 4).cast("long"))
    file_cost = by_size if source is None else F.coalesce(token_estimate(F.substring(_c(source), 1, S.SOURCE_CHARS)), by_size)
    return F.when(_c(type_) == "File", file_cost).otherwise(_c(fallback))


def content_hash(scope: Column | str, kind: Column | str, content: Column | str) -> Column:
    """C4"""
    return F.sha2(F.concat_ws("|", _c(scope), _c(kind), _c(content)), 256)


def idle_micros(last: Column | str, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(last), now)


def salience(last: Column | str, now: Column, half_life_days: float = S.HALF_LIFE_DAYS) -> Column:
    """Halves for each half-life of idleness; a time in the future counts as now."""
    days = F.greatest(F.lit(0.0), idle_micros(last, now).cast("double") / 86_400_000_000.0)
    return F.pow(F.lit(0.5), days / half_life_days)


def effective_ttl(ttl: Column | str, scope: Column | str, session_ttl: int = S.SESSION_TTL) -> Column:
    """C6"""
    return F.coalesce(_c(ttl).cast("long"), F.when(_c(scope) == "session", F.lit(session_ttl).cast("long")))


def is_expired(last: Column | str, now: Column, ttl: Column | str) -> Column:
    """idle for longer than the ttl; no ttl never expires."""
    return F.coalesce(idle_micros(last, now) > _c(ttl).cast("long") * 1_000_000, F.lit(False))


def call_cost(provider: Column | str, model: Column | str, tokens_in: Column | str, tokens_out: Column | str, pricing: dict = S.PRICING) -> Column:
    """By provider and model, else by provider, else nothing; dollars to six places."""

    def rate(k: int) -> Column:
        exact = lookup({f"{p}\x1f{m}": r[k] for (p, m), r in pricing.items() if m != "*"}, F.concat_ws("\x1f", _c(provider), _c(model)))
        wide = lookup({p: r[k] for (p, m), r in pricing.items() if m == "*"}, _c(provider))
        return F.coalesce(exact.cast("double"), wide.cast("double"), F.lit(0.0))

    return half_even(_c(tokens_in) / 1_000_000.0 * rate(0) + _c(tokens_out) / 1_000_000.0 * rate(1), 6)


def tokens_saved(raw: Column | str, actual: Column | str, estimated: Column | str) -> Column:
    """C8"""
    return F.greatest(F.lit(0).cast("long"), _c(raw) - F.coalesce(_c(actual), _c(estimated)))


def tier_of(kind: Column | str) -> Column:
    """C9"""
    return F.coalesce(lookup(S.TIERS, _c(kind)), F.lit(S.LAST_TIER))


def severity_rank(severity: Column | str) -> Column:
    """C10"""
    return F.coalesce(lookup(S.SEVERITY_RANK, _c(severity)), F.lit(3))


def confidence_rank(name: Column | str) -> Column:
    return F.coalesce(lookup(S.CONFIDENCE_RANK, _c(name)), F.lit(0))


def glob_to_regex(glob: str) -> str:
    """C11 for one pattern: * and ? also cross /, [!x] negates, the whole name must match."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2 if glob[i : i + 1] == "!" else i + 1)) > 0:
            inner = glob[i:end].replace("\\", "\\\\")
            out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def surrogate_id(prefix: str, *keys: Column | str) -> Column:
    """An id that follows from its keys, so that a repeated run gives the same one."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *map(_c, keys)), 256), 1, 26))


# The digits of base 32 as conv writes them and as identifiers have them.
_BASE32, _ULID = "0123456789abcdefghijklmnopqrstuv", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(at: Column | str, *keys: Column | str) -> Column:
    """A sortable id of 26 digits: ten for the milliseconds of a timestamp, sixteen that follow from the keys, so a repeated run gives the same one."""
    digest = F.sha2(F.concat_ws("|", *map(_c, keys)), 256)
    parts = [F.lpad(F.lower(F.conv(F.unix_millis(_c(at)).cast("string"), 10, 32)), 10, "0")]
    parts += [F.lpad(F.lower(F.conv(F.substring(digest, k, 10), 16, 32)), 8, "0") for k in (1, 11)]
    return F.translate(F.concat(*parts), _BASE32, _ULID)


def setting(value: Column | str) -> Column:
    """What coerced makes of a text, as struct(kind, value): true or false, null, a whole number, or text."""
    low = F.lower(F.trim(_c(value)))
    number = F.regexp_extract(_c(value), r"^\s*([+-]?[0-9]+)\s*$", 1)
    return (
        F.when(low.isin("true", "false"), F.struct(F.lit("boolean").alias("kind"), low.alias("value")))
        .when(low.isin("null", "none"), F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("value")))
        .when(number != "", F.struct(F.lit("integer").alias("kind"), number.cast("decimal(38,0)").cast("string").alias("value")))
        .otherwise(F.struct(F.lit("text").alias("kind"), _c(value).alias("value")))
    )


def purpose_text(type_: Column, label: Column, language: Column, size: Column, files: Column) -> Column:
    """C14: the sentence of a card."""
    return (
        F.when(type_ == "File", F.concat(label, F.lit(": "), F.coalesce(language, F.lit("unknown")), F.lit(" file ("), F.coalesce(size, F.lit(0)).cast("string"), F.lit(" bytes).")))
        .when(type_ == "Module", F.concat(F.lit("Module '"), label, F.lit("' containing "), F.coalesce(files, F.lit(0)).cast("string"), F.lit(" file(s).")))
        .otherwise(F.concat(type_, F.lit(" '"), label, F.lit("'.")))
    )


def risk_text(path: Column, churn: Column) -> Column:
    """The risk of a hotspot, else null."""
    return F.when(churn > 0, F.concat(path, F.lit(" changes frequently (hotspot)")))


def change_text(churn: Column) -> Column:
    """Recent commits of a hotspot, else null."""
    return F.when(churn > 0, F.concat(churn.cast("string"), F.lit(" recent commits")))


def profile_text(root: Column, files: Column, modules: Column, languages: Column) -> Column:
    """One line on a repository."""
    return F.concat(F.lit("repo "), F.coalesce(root, F.lit("")), F.lit(": "), files.cast("string"), F.lit(" files, "), modules.cast("string"), F.lit(" modules; languages: "), F.array_join(languages, ","))


def finding_text(label: Column, recommendation: Column, violations: Column) -> Column:
    """One line on a finding; an empty recommendation falls back to the label."""
    rec = F.when(F.coalesce(recommendation, F.lit("")) == "", label).otherwise(recommendation)
    return F.concat(label, F.lit(": "), rec, F.lit(" (violations: "), F.coalesce(F.size(violations), F.lit(0)).cast("string"), F.lit(")"))


def rendered(items: Column, title: str) -> Column:
    """C17: a heading and one line for each struct(kind, content); empty without items."""
    lines = F.transform(items, lambda x: F.concat(F.lit("- ["), x["kind"], F.lit("] "), x["content"]))
    return F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n"))).otherwise("")


def source_head(text: Column, path: Column, chars: int = S.SOURCE_CHARS) -> Column:
    """The first characters of a source; the path where it cannot be read."""
    return F.coalesce(F.substring(text, 1, chars), path)


def deep_merge(base: dict, over: dict) -> dict:
    """Maps merge key by key, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerced(value: str) -> object:
    """Environment text as true/false, null, integer, or itself."""
    low = value.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    return int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else value


def markdown(title: Column, sections: dict[str, Column]) -> Column:
    """C20: a title, and a heading and list for each array of texts."""
    parts = [F.concat(F.lit("# "), title)]
    for name, items in sections.items():
        parts.append(F.concat(F.lit(f"\n## {name}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    return F.concat_ws("\n", *parts)


def safe_member(name: Column) -> Column:
    """A flat name below snapshots/, without a way up."""
    return name.rlike(r"^snapshots/[^/\\]+$") & ~name.startswith("snapshots/..")


def with_estimates(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, token_estimate(text))
