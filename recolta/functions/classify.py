"""Rule classifiers, redaction and fingerprints over text columns. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recolta.functions.text import clamp, text_or_empty

# Patterns with their reasons and weights.
NOISE = (
    (r"\b(like\s+and\s+subscribe|follow\s+for\s+more|comment\s+below|tag\s+\d+\s+friends)\b", "engagement_bait", 0.25),
    (r"(free\s+money|crypto\s+giveaway|airdrop|dm\s+me\s+now)", "spam_like_content", 0.35),
    (r"\b(repost|retweet|shared\s+from|via\s+@)\b", "repetitive_repost", 0.2),
)
MEME = r"\b(meme|template|reaction|shitpost)\b"
PROMPT = (
    (r"(?i)\bignore\s+(all|previous)\s+instructions\b", "ignore_previous_instructions", 0.45),
    (r"(?i)\bsystem\s+prompt\b", "system_prompt_manipulation", 0.25),
    (r"(?i)\bdeveloper\s+message\b", "developer_message_manipulation", 0.25),
    (r"(?i)\bjailbreak\b", "jailbreak_pattern", 0.35),
    (r"<\|.*?\|>", "token_roleplay_sequence", 0.25),
    (r"(?i)\b(roleplay|act as)\s+(system|assistant)\b", "roleplay_override", 0.3),
)
REVEAL = r"(?i)\breveal\s+(secrets?|credentials?)\b"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\w)\+?\d[\d\s().-]{8,}\d\b"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]{16,}\b"
KEY = r"(?i)\b(?:sk|rk|pk|api|key)[_-]?[A-Za-z0-9]{16,}\b"
SENSITIVE = (
    (KEY, "api_key"),
    (r"(?i)\b(?:Bearer|token)\s+[A-Za-z0-9._\-+/=]{16,}\b", "token"),
    (r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S+", "password"),
    (r"(?i)(discord\.gg/|slack\.com/invite/|t\.me/\+)", "invite_link"),
    (EMAIL, "personal_email"),
    (PHONE, "phone_number"),
    (r"(?i)https?://\S+(token|session|auth)=\S+", "auth_session_url"),
)
GRAVE = ("api_key", "token", "password", "auth_session_url")


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _weight(hit: Column, w: float) -> Column:
    return F.when(hit, w).otherwise(0.0)


def _reasons(hits: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(h, F.lit(r)) for h, r in hits]))


def noise(text: Column, media: Column) -> tuple[Column, Column]:
    """(score, first reason)."""
    low = F.lower(text_or_empty(text))
    hits = [(F.length(F.trim(low)) < 18, "low_information_content", 0.35)]
    hits += [(low.rlike(p), r, w) for p, r, w in NOISE]
    hits += [(low.rlike(MEME) & (F.length(low) < 120), "duplicate_meme_variant", 0.18), (F.coalesce(F.size(media), F.lit(0)) > 3, "high_link_density", 0.1)]
    return clamp(_sum([_weight(h, w) for h, _, w in hits])), F.try_element_at(_reasons([(h, r) for h, r, _ in hits]), F.lit(1))


def prompt_risk(text: Column) -> tuple[Column, Column]:
    """(score, first reason): weighted patterns, and a long base64 word."""
    t = text_or_empty(text)
    clean = lambda w: F.regexp_replace(F.regexp_replace(w, r"^['\"]+", ""), r"['\"]+$", "")
    base64 = lambda w: (F.length(w) >= 24) & (F.length(clean(w)) % 4 == 0) & clean(w).rlike("^[A-Za-z0-9+/]+={0,2}$")
    hits = [(t.rlike(p), r, w) for p, r, w in PROMPT] + [(F.exists(F.split(t, r"\s+"), base64), "encoded_prompt_like_payload", 0.15)]
    return F.round(clamp(_sum([_weight(h, w) for h, _, w in hits])), 6), F.try_element_at(_reasons([(h, r) for h, r, _ in hits]), F.lit(1))


def prompt_injection(text: Column) -> tuple[Column, Column]:
    """(suspicious, signals)."""
    t = text_or_empty(text)
    signals = _reasons([(t.rlike(PROMPT[0][0]), PROMPT[0][1]), (t.rlike(REVEAL), "reveal_secrets"), (t.rlike(PROMPT[1][0]), PROMPT[1][1])])
    return (F.size(signals) > 0) | (prompt_risk(text)[0] >= 0.4), signals


def sensitivity(text: Column, url: Column) -> tuple[Column, Column]:
    """(level none, low, medium or high; reasons)."""
    both = F.concat(text_or_empty(text), F.lit("\n"), text_or_empty(url))
    reasons = _reasons([(both.rlike(p), r) for p, r in SENSITIVE])
    level = F.when(F.size(reasons) == 0, "none").when(F.arrays_overlap(reasons, F.array(*map(F.lit, GRAVE))), "high").when(F.size(reasons) >= 2, "medium").otherwise("low")
    return level, reasons


def sensitive_scan(text: Column) -> Column:
    """Reasons why a text should not be indexed."""
    t = text_or_empty(text)
    return _reasons([(t.rlike(EMAIL), "email"), (t.rlike(PHONE), "phone"), (t.rlike(BEARER), "bearer_token"), (t.rlike(KEY), "api_key")])


def redact(text: Column) -> Column:
    out = text
    for pattern, mark in ((EMAIL, "[REDACTED_EMAIL]"), (PHONE, "[REDACTED_PHONE]"), (BEARER, "Bearer [REDACTED_TOKEN]"), (KEY, "[REDACTED_KEY]")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def sanitize(text: Column) -> Column:
    out = F.regexp_replace(text_or_empty(text), PROMPT[0][0], "[SANITIZED_INSTRUCTION]")
    return F.regexp_replace(out, REVEAL, "[SANITIZED_SECRET_REQUEST]")


def guarded_text(text: Column) -> Column:
    """The text, or a marker where its prompt risk is 0.6 or more."""
    return F.when(prompt_risk(text)[0] >= 0.6, "[SANITIZED_UNTRUSTED_CONTENT]").otherwise(text)


def time_bucket(t: Column, hours: Column | int = 2) -> Column:
    """Number of the tumbling window of `hours` that an instant falls in, as a string."""
    width = (F.lit(hours) if isinstance(hours, int) else hours).cast("long") * 3600
    return F.floor(F.unix_timestamp(t) / width).cast("long").cast("string")


def fingerprint(canonical: Column, platform: Column, text: Column, author: Column, bucket: Column) -> Column:
    """sha256 of what makes a capture the same within a time bucket."""
    parts = [text_or_empty(canonical), text_or_empty(platform), F.substring(text_or_empty(text), 1, 240), F.substring(text_or_empty(author), 1, 100), bucket]
    return F.sha2(F.concat_ws("|", *parts), 256)
