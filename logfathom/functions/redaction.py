"""Masking of secrets and personal data, as chained column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.dialect import BadPattern, bind, rewrite

# What each category matches (JavaScript dialect), in the order in which they apply.
SECRET = r"\b(pass(?:word|wd)?|pwd|secret|token|api[_-]?key|apikey|auth(?:orization)?|access[_-]?token|refresh[_-]?token|client[_-]?secret|session[_-]?id)\b(\s*[:=]\s*\"?)([^\s,;\"']+)"
BEARER = r"\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}:?){0,5}\b"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
TOKEN = r"\b(?=[A-Za-z0-9+/_=-]*\d)(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}\b"
CATEGORIES = ["secret", "jwt", "email", "ipv4", "ipv6", "card", "token"]


# What a text must have for a category's pattern to be tried at all: each pattern's matches have it too.
_NEEDS = {
    "secret": r"[:=]", "bearer": rewrite(r"bearer\s", ignore_case=True).java, "jwt": r"eyJ", "email": r"@", "ipv4": r"[0-9]\.[0-9]", "ipv6": r":[0-9a-fA-F]{0,4}:",
    "card": r"[0-9](?:[ -]?[0-9]){12}", "token": r"(?:^|[^A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}",
}


def _where(need: str, c: Column, f) -> Column:
    """f of a text that has what its pattern needs, others as they are; the text is computed once."""
    return bind(c, lambda x: F.when(x.rlike(_NEEDS[need]), f(x)).otherwise(x))


def mask_secret(c: Column) -> Column:
    """``key=value`` to ``key=[secret]``, ``Bearer x`` to ``Bearer [secret]``."""
    keyed = _where("secret", c, lambda x: F.regexp_replace(x, rewrite(SECRET, ignore_case=True).java, "$1$2[secret]"))
    return _where("bearer", keyed, lambda x: F.regexp_replace(x, rewrite(BEARER, ignore_case=True).java, "Bearer [secret]"))


def mask_card(c: Column) -> Column:
    """Digit runs that pass the Luhn check to ``[card]``; others stay."""
    java = rewrite(CARD).java

    def mask(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(java), F.lit(0))
        masks = F.transform(found, lambda m: F.when(F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")), F.lit("[card]")).otherwise(m))
        return F.array_join(F.zip_with(F.split(x, java, -1), masks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return _where("card", c, mask)


def _plain(pattern: str, label: str, need: str | None = None):
    java, to = rewrite(pattern).java, label.replace("\\", r"\\").replace("$", r"\$")
    replace = lambda x: F.regexp_replace(x, java, to)
    return replace if need is None else lambda c: _where(need, c, replace)


_MASKS = {
    "secret": mask_secret, "jwt": _plain(JWT, "[jwt]", "jwt"), "email": _plain(EMAIL, "[email]", "email"), "ipv4": _plain(IPV4, "[ip]", "ipv4"),
    "ipv6": _plain(IPV6, "[ip]", "ipv6"), "card": mask_card, "token": _plain(TOKEN, "[token]", "token"),
}


def mask(category: str, c: Column) -> Column:
    return _MASKS[category](c)


def redact(c: Column, disabled: Iterable[str] = (), custom: Iterable[tuple[str, str]] = ()) -> Column:
    """Mask all categories but the disabled, then custom (label, pattern) pairs; empty or invalid patterns are skipped."""
    off = set(disabled)
    for category in CATEGORIES:
        if category not in off:
            c = mask(category, c)
    for label, pattern in custom:
        if pattern:
            try:
                c = _plain(pattern, f"[{label.strip() or 'redacted'}]")(c)
            except BadPattern:
                continue
    return c


def find_sensitive(c: Column) -> Column:
    """The categories that would mask something in a text, as an array in their order. As for the masks, a pattern runs only
    on texts that have what it needs."""
    found = lambda need, pattern: c.rlike(_NEEDS[need]) & c.rlike(pattern.java)
    cards = F.exists(F.regexp_extract_all(c, F.lit(rewrite(CARD).java), F.lit(0)), lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")))
    hit = {
        "secret": found("secret", rewrite(SECRET, ignore_case=True)) | found("bearer", rewrite(BEARER, ignore_case=True)), "jwt": found("jwt", rewrite(JWT)), "email": found("email", rewrite(EMAIL)),
        "ipv4": found("ipv4", rewrite(IPV4)), "ipv6": found("ipv6", rewrite(IPV6)), "card": c.rlike(_NEEDS["card"]) & cards, "token": found("token", rewrite(TOKEN)),
    }
    return F.array_compact(F.array(*[F.when(hit[k], F.lit(k)) for k in CATEGORIES]))
