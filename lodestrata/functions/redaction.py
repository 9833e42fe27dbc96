"""Redaction: the baseline, the required engine, the stand-in, and the oracles that measure them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
MARK_IN_JAVA = r"\[REDACTED\]"

#: What the baseline looks for, in the order in which it does.
PEM = r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----"
PREFIXES = ("ghp_", "github_pat_", "sk-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "-----BEGIN ")
AFTER_PREFIX = r"[^ \t\n\"',;)]{4,}"
JSON_KEYS = ("password", "token", "secret", "api_key", "access_key", "private_key", "auth_token")
JSON_VALUE = r'(?i)("(?:password|token|secret|api_key|access_key|private_key|auth_token)"\s*:\s*")[^"]{20,}"'
KEY_VALUE = r"(^|\n)((?:export\s+)?[A-Z_]{3,}(?:SECRET|KEY|TOKEN|PASSWORD|AUTH)[A-Z_]*\s*=\s*[\"']?)[A-Za-z0-9+/=_\-]{20,}"


def baseline_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) in order: PEM blocks, prefix tokens, JSON values, KEY=value."""
    return [(PEM, MARK), *((p + AFTER_PREFIX, MARK) for p in PREFIXES), (JSON_VALUE, rf'$1{MARK}"'), (KEY_VALUE, rf"$1$2{MARK}")]


#: Words without one of which, in lower case, the rule at that place can't match; most texts pass most rules at once.
BASELINE_MARKS = [("-----begin ",), *((p.lower(),) for p in PREFIXES), JSON_KEYS, ("secret", "key", "token", "password", "auth")]


def _apply(text: Column, rules: list[tuple[str, str]], marks: list[tuple[str, ...]]) -> Column:
    """The rules one after the other, each only where the text holds one of its marks; a step's text is bound to a variable, not written out again."""

    def step(pattern: str, to: str, words: tuple[str, ...]):  # noqa: ANN202
        def one(t: Column) -> Column:
            low = F.lower(t)
            found = F.contains(low, F.lit(words[0]))
            for w in words[1:]:
                found = found | F.contains(low, F.lit(w))
            return F.when(found, F.regexp_replace(t, pattern, to)).otherwise(t)

        return one

    for (pattern, to), words in zip(rules, marks, strict=True):
        text = F.transform(F.array(text), step(pattern, to, words))[0] if words else F.regexp_replace(text, pattern, to)
    return text


def redact_baseline(text: Column) -> Column:
    """The measured baseline; later rules see what earlier ones left."""
    return _apply(text, baseline_rules(), BASELINE_MARKS)


def redact_stand_in(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:github_pat_|ghp_|sk-|xoxb-)[A-Za-z0-9_-]+", MARK)


#: What passes although it looks random: commit and content hashes, UUIDs, ULIDs.
ALLOWED = r"(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9A-HJKMNP-TV-Z]{26})"


def engine_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) of the required engine's pattern stage.

    Prefixes need a left boundary, so a word such as task-force stays. Tokens
    shaped like three dotted base64url parts go whatever they start with. Values
    of sensitive keys go in JSON with either quote, in KEY=value, `key = value`
    and YAML of any case, in URLs' user part and query; values that are hashes,
    UUIDs or ULIDs are left (see ALLOWED).
    """
    bound = r"(^|[^A-Za-z0-9])"
    # looked at first, so that a word with no sign after it is passed over at once
    key = r"(?=[A-Za-z0-9_.-]++\s*[=:])[A-Za-z0-9_.-]*(?i:secret|key|token|passwd|password|auth|credential)[A-Za-z0-9_.-]*"
    value = r"[A-Za-z0-9+/_.~-]{20,}={0,2}"
    return [
        (PEM, MARK),
        (rf"{bound}(?:ghp_|gho_|ghs_|github_pat_|sk-|xox[abps]-)[A-Za-z0-9_-]{{10,}}", rf"$1{MARK}"),
        (rf"{bound}AKIA[0-9A-Z]{{12,20}}\b", rf"$1{MARK}"),
        (rf"{bound}[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}", rf"$1{MARK}"),
        (r"(://[^\s:/@]+:)(?!" + MARK_IN_JAVA + r")[^\s@/]{8,}@", rf"$1{MARK}@"),
        (rf"([?&](?i:token|key|secret|password|auth)[A-Za-z_]*=)(?!{ALLOWED}(?:[^A-Za-z0-9]|$)){value}", rf"$1{MARK}"),
        (rf"((?i:\"(?:{'|'.join(JSON_KEYS)})\"\s*:\s*\"|'(?:{'|'.join(JSON_KEYS)})'\s*:\s*'))(?!{ALLOWED}[\"'])[^\"'\n]{{20,}}", rf"$1{MARK}"),
        (rf"((?:^|[\s;])(?:export\s+)?{key}\s*[=:]\s*[\"']?)(?!{ALLOWED}(?:[^A-Za-z0-9+/_-]|$)){value}", rf"$1{MARK}"),
        (rf"((?:^|[\s;])(?:export\s+)?[A-Z][A-Z0-9_]*_URL=[\"']?)(?!{ALLOWED}(?:[^A-Za-z0-9+/_-]|$)){value}", rf"$1{MARK}"),
    ]


ENGINE_MARKS = [("-----begin ",), ("ghp_", "gho_", "ghs_", "github_pat_", "sk-", "xox"), ("akia",), (), ("://",), ("?", "&"), JSON_KEYS, ("secret", "key", "token", "passw", "auth", "credential"), ("_url=",)]


def redact_engine(text: Column, sink: str = "persist") -> Column:
    """The required engine; every sink is treated alike, and sink stays a parameter."""
    return _apply(text, engine_rules(), ENGINE_MARKS)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character: of the sorted characters, each run's length is a count."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    # sum of run * log2(run) over all runs; H = log2(n) - sum / n
    closed = lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"].cast("double"))).otherwise(0.0)
    walked = F.aggregate(chars, start, lambda s, c: F.when(s["last"] == c, F.struct(c.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(F.struct(c.alias("last"), F.lit(1).alias("run"), closed(s).alias("sum"))), closed)
    n = F.size(chars)
    return F.when(F.length(text) > 0, F.log2(n.cast("double")) - walked / n).otherwise(0.0)


def high_entropy_values(text: Column, least: float = 3.5) -> Column:
    """Values of KEY=value and key: value whose entropy reaches `least`, but for the allowed shapes."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_=-]{20,})"), F.lit(1))
    return F.filter(found, lambda v: (entropy(v) >= least) & ~v.rlike(rf"^{ALLOWED}$"))


def quarantine(redacted: Column) -> Column:
    """True if the redacted text still holds a value that looks like a secret."""
    return F.size(high_entropy_values(redacted)) > 0


def leaked(secret: Column, payload: Column) -> Column:
    """A secret of at least eight characters that the payload still holds, case and outer space aside."""
    return (F.length(_plain(secret)) >= 8) & F.contains(_plain(payload), _plain(secret))


def false_positive(sample: Column, before: Column, after: Column) -> Column:
    """There before, gone after, case and outer space aside."""
    return F.contains(_plain(before), _plain(sample)) & ~F.contains(_plain(after), _plain(sample))


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def gate_failure(is_leaked: Column, residual: Column) -> Column:
    return is_leaked & residual.isNull()
