"""Secret redaction (P1, P2) and credential-shaped paths.

The rules are this project's own; they cover the families a packer must not
leak: provider tokens, cloud keys, JSON web tokens, PEM private keys and quoted
assignments to secret-looking names.  Patterns stay in the subset shared by the
common regex engines (no look-around, no possessive quantifiers) so that they
can be checked against another engine.  Every rule has literals or a cheap
pattern that must be present, which spares almost every file the full rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.fixed import REDACTED


# Shapes of tokens that are secret wherever they stand, each with
# literals one of which every match contains.
TOKEN_SHAPES = {
    "json web token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    "model provider": (r"sk-[A-Za-z0-9_-]{20,}", ("sk-",)),
    "GitHub personal": (r"github_pat_[A-Za-z0-9_]{22,}", ("github_pat_",)),
    "GitHub": (r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "GitLab": (r"glpat-[A-Za-z0-9_-]{20,}", ("glpat-",)),
    "Slack": (r"xox[abeoprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    "Stripe": (r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", ("k_live_", "k_test_")),
    "npm": (r"npm_[A-Za-z0-9]{36}", ("npm_",)),
    "Hugging Face": (r"hf_[A-Za-z0-9]{30,}", ("hf_",)),
    "SendGrid": (r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", ("SG.",)),
    "Twilio": (r"SK[0-9a-f]{32}\b", ("SK",)),
    "AWS key id": (r"(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("AKIA", "ASIA")),
}


@dataclass(frozen=True)
class SecretRule:
    pattern: str
    replacement: str = REDACTED


# Rules in order of application.  All token shapes are one alternation, so that
# suspect text is walked three times and not once per shape.
RULES = (
    SecretRule(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    SecretRule(r"\b(?:" + "|".join(shape for shape, _ in TOKEN_SHAPES.values()) + ")"),
    SecretRule(
        r"(?i)((?:api[_-]?key|secret|token|passw(?:or)?d|credential)[a-z0-9_-]{0,40}[\"']?\s*[:=]\s*)"
        r"([\"'])[A-Za-z0-9_+/=.~-]{12,}[\"']",
        r"$1$2" + REDACTED + r"$2",
    ),
)
NEEDLES = ("PRIVATE KEY-----", *(n for _, needles in TOKEN_SHAPES.values() for n in needles))
# A cheap necessary condition of the assignment rule: an operator and a quoted value.
ASSIGNED = r"[:=]\s*[\"'][A-Za-z0-9_+/=.~-]{12,}[\"']"


def may_hold_secret(text: Column) -> Column:
    """Necessary condition of all rules: some literal, or some quoted assignment."""
    test = F.lit(False)
    for needle in NEEDLES:
        test = test | F.contains(text, F.lit(needle))
    return test | F.rlike(text, F.lit(ASSIGNED))


def redacted(text: Column) -> Column:
    """Text with every secret replaced.

    Each rule works on the text left by the rules before it.  The chain names
    its input once per step, so it stays linear when the optimizer inlines it,
    and it runs only for text that may hold a secret at all.
    """
    out = text
    for rule in RULES:
        out = F.regexp_replace(out, F.lit(rule.pattern), F.lit(rule.replacement))
    return F.when(may_hold_secret(text), out).otherwise(text)


def _occurrences(text: Column, literal: str) -> Column:
    cut = F.length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.length(text) - cut) / len(literal)).cast("bigint")


def redactions(before: Column, after: Column) -> Column:
    """Number of replacements (P2): markers gained.

    No rule can match across a marker, so none is lost again.
    """
    gained = _occurrences(after, REDACTED) - _occurrences(before, REDACTED)
    return F.when(F.contains(after, F.lit(REDACTED)), gained).otherwise(F.lit(0).cast("bigint"))


def redact(files: DataFrame, content: str = "content", count: str = "redactions") -> DataFrame:
    """Replace secrets in ``content`` and add the number of replacements; 0 without text."""
    return (
        files.withColumn("_after", redacted(F.col(content)))
        .withColumn(count, redactions(F.col(content), F.col("_after")))
        .withColumn(content, F.col("_after"))
        .drop("_after")
    )


# Fixed value: shapes of paths that hold credentials, matched on the lower-cased path.
SUSPICIOUS_PATH = (
    r"(?:^|/)(?:"
    r"\.env(?:\.[^/]*)?"
    r"|\.npmrc|\.netrc|\.pypirc|\.htpasswd|\.git-credentials|\.pgpass"
    r"|id_(?:rsa|dsa|ecdsa|ed25519)"
    r"|[^/]*\.(?:pem|p12|pfx|key|jks|keystore|ppk)"
    r"|(?:service[-_]?account|credentials)[^/]*\.json"
    r"|secrets?\.(?:ya?ml|json|toml)"
    r")$"
)


def is_suspicious_path(path: Column) -> Column:
    """True for ``.env*``, key files, credential stores and the like."""
    return F.rlike(F.lower(path), F.lit(SUSPICIOUS_PATH))
