"""Label and name normalisation, and text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substring rules in the order in which they are tried, and the family each gives.
FAMILY_RULES = (("benign", "Benign"), ("ddos", "DDoS"), ("dos", "DoS"), ("portscan", "PortScan"), ("brute force", "BruteForce"), ("web", "WebAttack"), ("infiltration", "Infiltration"), ("heartbleed", "Heartbleed"), ("bot", "Bot"))


def normalize_label(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(value, F.lit("�"), F.lit(" ")), r"\s+", " "))


def family(value: Column, mapping: dict[str, str] | None = None, rules=FAMILY_RULES) -> Column:
    """An exact mapping first, then substring rules in order, else the label with spaces as underscores."""
    label = normalize_label(value)
    out = F.replace(label, F.lit(" "), F.lit("_"))
    for needle, name in reversed(rules):
        out = F.when(F.contains(F.lower(label), F.lit(needle)), F.lit(name)).otherwise(out)
    for exact, name in (mapping or {}).items():
        out = F.when(label == exact, F.lit(name)).otherwise(out)
    return out


def safe_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def safe_stem(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")


def truthy(value: Column) -> Column:
    return F.lower(value.cast("string")).isin("true", "1")


def truthy_trimmed(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes")


def strict_bool(value: Column) -> Column:
    """Anything but true, false, 1 and 0 is an error."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def error_type(truth: Column, decision: Column) -> Column:
    return F.when((truth == 1) & (decision == 1), "TP").when((truth == 0) & (decision == 0), "TN").when(decision == 1, "FP").otherwise("FN")


def error_type_multiclass(truth: Column, decision: Column, benign: int = 0) -> Column:
    return F.when(truth == decision, "correct").when(truth == benign, "benign_to_attack").when(decision == benign, "attack_to_benign").otherwise("attack_to_other")


def session_key(src: Column, dst: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """The same for both directions: ends in text order, each with its own port."""
    forward = src <= dst
    parts = [F.when(forward, a).otherwise(b).cast("string") for a, b in ((src, dst), (dst, src), (src_port, dst_port), (dst_port, src_port))]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts], F.coalesce(protocol.cast("string"), F.lit("")))


def format_decimal(value: Column, decimals: int) -> Column:
    """Fixed decimals without a leading zero."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"^(-?)0\.", "$1.")


#: Patterns of secrets and personal paths by rule.
SENSITIVE = {
    "provider_token": r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})",
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "credential_literal": r"""(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[:=]\s*["'][^"']{12,}["']""",
    "personal_absolute_path": r"""(?i)/(?:Users|home)/[^/\s"'<>]+""",
    "windows_personal_path": r"""(?i)\b[A-Z]:\\Users\\[^\\\s"']+""",
}


def sensitive(text: Column) -> Column:
    """The rules that a text breaks, in their order; texts are read whole, so no finding can straddle two blocks."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SENSITIVE.items()]), lambda x: x.isNotNull())


def encoded(label: Column, classes: list[str]) -> Column:
    """The place of a label in the list of classes; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(label, F.lit("null")))).cast("int")
    for i, name in reversed(list(enumerate(classes))):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out
