"""Scalar text functions as Column expressions (Python only where one pass over entities or NFKC is needed)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formatting tags that survive cleaning, and the entities that are decoded by plain replacement.
_KEPT = {
    "i": ("i", "italic", "jats:italic"), "b": ("b", "bold", "jats:bold"), "em": ("em",), "strong": ("strong",), "sub": ("sub", "jats:sub"), "sup": ("sup", "jats:sup"), "br": ("br",),
}
_BLOCKS = "p|div|li|ul|ol|section|h[1-6]|jats:p|jats:title|jats:sec|jats:list-item"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def title_key(c: Column | str) -> Column:
    """Letters and digits of a title without markup and entities, in lower case; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"<[^>]+>", " "), r"&[a-z#0-9]+;", " ")
    return F.nullif(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def _decoded(s: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        body = m.group(1)
        if body.startswith("#"):
            code = int(body[2:], 16) if body[1:2] in "xX" else int(body[1:])
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()
        return _NAMED.get(body, m.group())

    pattern = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]{2,6});")
    return s.map(lambda t: None if t is None else pattern.sub(one, t))


def decode_entities(c: Column | str) -> Column:
    """Entities decoded in one pass (so ``&amp;lt;`` gives ``&lt;``); rows without an ampersand never leave the JVM."""
    return F.when(_c(c).contains("&"), F.pandas_udf(_decoded, "string")(_c(c))).otherwise(_c(c))


def sanitize_html(c: Column | str) -> Column:
    """Only plain formatting tags are left, without attributes; everything else is text and escaped.

    Wanted tags are set aside as private-use characters, all other markup goes, the rest is escaped, and the tags come back.
    """
    t = F.translate(_replace_all(_c(c), ENTITIES), "".join(chr(0xE000 + i) for i in range(2 * len(_KEPT))), "")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    for i, names in enumerate(_KEPT.values()):
        t = F.regexp_replace(t, rf"(?i)<(?:{'|'.join(names)})(?:\s[^<>]*)?/?>", chr(0xE000 + 2 * i))
        t = F.regexp_replace(t, rf"(?i)</(?:{'|'.join(names)})\s*>", chr(0xE001 + 2 * i))
    t = F.regexp_replace(F.regexp_replace(t, rf"(?i)</?(?:{_BLOCKS})(?:\s[^<>]*)?/?>", " "), r"(?i)</?[a-z][\w:.-]*(?:\s[^<>]*)?/?>", "")
    t = F.trim(F.regexp_replace(t, r"[ \t]{2,}", " "))
    t = F.regexp_replace(t, r"&(?!#?\w{1,31};)", "&amp;")
    t = _replace_all(t, (("<", "&lt;"), (">", "&gt;")))
    back = tuple(p for i, name in enumerate(_KEPT) for p in ((chr(0xE000 + 2 * i), f"<{name}>"), (chr(0xE001 + 2 * i), f"</{name}>")))
    return _replace_all(t, back)


def html_to_text(c: Column | str) -> Column:
    """Line breaks as semicolons, tags dropped, five entities decoded."""
    t = F.regexp_replace(F.regexp_replace(_c(c), r"(?i)<br\s*/?>", "; "), r"<[^>]+>", "")
    return _replace_all(t, ENTITIES)


def sanitize_url(c: Column | str) -> Column:
    """Plain http(s) addresses; null for everything else."""
    u = _c(c)
    return F.when(u.rlike(r"(?i)^https?://") & ~u.rlike("[\\s\"'<>`]"), u)


def strip_invisible(c: Column | str) -> Column:
    """Control characters (but tab and line ends), zero-width and direction marks taken out."""
    return F.regexp_replace(_c(c), "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u2069\\uFEFF]", "")


def truncate(c: Column | str, n: int, mark: str = "...") -> Column:
    """The first n characters and a mark where there are more."""
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit(mark))).otherwise(_c(c))


def md_escape(c: Column | str) -> Column:
    """Characters with a meaning in Markdown, escaped."""
    return F.regexp_replace(_c(c), r"([\\`*_\[\]<>])", r"\\$1")


def md_link_target(c: Column | str) -> Column:
    """Characters that would end a Markdown link, percent-encoded."""
    return _replace_all(_c(c), (("%", "%25"), (" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E")))


def item_key(*parts: Column | str) -> Column:
    """md5 of the parts joined by bars; a missing part reads NA."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_c(p), F.lit("NA")) for p in parts]))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^\p{L}\p{N}]", "-"), r"^-+|-+$", "")


def human(c: Column | str) -> Column:
    """Codes in capitals as a phrase; anything else only loses its underscores."""
    t = F.trim(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("_"), F.lit(" ")))
    shout = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return F.when(shout, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))).otherwise(t)


def join_date_label(start: Column, end: Column, status: Column) -> Column:
    """Start, end (ongoing while the trial is active) and status in one label."""
    ending = F.when(status.rlike("(?i)active|recruiting|enrolling"), F.lit("Ongoing")).otherwise(end)
    part = lambda name, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}: "), v))
    return F.array_join(F.array_compact(F.array(part("Start", start), part("End", ending), part("Status", status))), " | ")


def normal_doi(c: Column | str) -> Column:
    """A DOI without resolver or scheme, case kept; null if blank."""
    return F.nullif(F.regexp_replace(F.trim(_c(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.[a-z]+/|info:doi/|doi:\s*)", ""), F.lit(""))


def normal_date(c: Column | str) -> Column:
    """ISO time stamps cut to their date; other spellings stay."""
    return F.regexp_replace(_c(c), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ].*$", "$1")


def normal_authors(c: Column | str) -> Column:
    """One separator between authors, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(c)), r"\s*[;|]+\s*(?:[;|]\s*)*", "; "), r"^[;\s]+|[;\s]+$", "")


def any_date(c: Column | str) -> Column:
    """A date from day, month or year spellings (a month is its first day, a year its first); null if none fits."""
    t = F.regexp_replace(F.trim(_c(c)), r"^Start:\s*|\s*\|.*$", "")
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10)).when(t.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^[0-9]{4}$"), F.concat(t, F.lit("-01-01")))
    us = F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(t, F.lit("M/d/yyyy")).cast("date"))
    return F.coalesce(day.try_cast("date"), us, F.when(t.rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$"), F.try_to_timestamp(t, F.lit("d MMM yyyy")).cast("date")))


def phase_label(phases: Column) -> Column:
    """An array of phase codes as a label; the literal NA and blanks are dropped."""
    kept = F.filter(F.transform(phases, lambda p: F.upper(F.trim(p))), lambda p: (p != "") & (p != "NA"))
    pretty = F.transform(kept, lambda p: F.when(p == "EARLY_PHASE1", F.lit("Early Phase 1")).when(p.rlike("^PHASE[0-9]$"), F.concat(F.lit("Phase "), F.substring(p, 6, 1))).otherwise(F.replace(p, F.lit("_"), F.lit(" "))))
    return F.nullif(F.array_join(F.array_distinct(pretty), "/"), F.lit(""))


def phase_number(c: Column) -> Column:
    """The largest digit named in a phase; null where there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int")))


def inverted_text(index: Column) -> Column:
    """A text from its inverted index (word to positions)."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda s: s["w"]), " ")


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.replace("∆", "Δ")))


def nfkc(c: Column | str) -> Column:
    """Compatibility characters in their plain form, the increment sign as the letter; only texts beyond ASCII leave the JVM."""
    t = _c(c)
    return F.when(t.rlike(r"^[\x00-\x7F]*$"), t).otherwise(F.pandas_udf(_nfkc, "string")(t))


def _nfkc_key(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        for mark, new in (("®", ""), ("™", ""), ("©", ""), ("∆", "Δ")):
            t = t.replace(mark, new)
        return "".join(ch for ch in unicodedata.normalize("NFKC", t).upper() if ch.isalnum())

    return s.map(one)


def alias_key(c: Column | str) -> Column:
    """A name reduced to its letters and digits in capitals; only names beyond ASCII leave the JVM."""
    t = _c(c)
    return F.when(t.rlike(r"^[\x00-\x7F]*$"), F.regexp_replace(F.upper(t), "[^A-Z0-9]", "")).otherwise(F.pandas_udf(_nfkc_key, "string")(t))


def split_terms(c: Column | str) -> Column:
    """The parts of a text between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """``1 trial``, ``2 trials``."""
    return F.concat(F.format_number(n, 0), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many or one + 's'}")))


def session_hash(c: Column | str, salt: str = "") -> Column:
    """A session id that does not lead back to the client: the first 16 digits of a salted digest."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _c(c)), 256), 1, 16)


def log_time(c: Column | str) -> Column:
    """A log's time stamp: ISO with or without zone, or with a zone's name behind it, which is dropped."""
    t = F.trim(_c(c))
    bare = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])T(?=[0-9])", " "), r"\s*(?:Z|[A-Z]{2,5})$", "")
    return F.try_to_timestamp(bare)


def truncated_text(c: Column | str, n: int) -> Column:
    """struct(text, total_chars, truncated): the readable text cut to n characters and marked, and the length before."""
    raw, plain = _c(c), strip_invisible(c)
    long = F.length(plain) > n
    return F.struct(F.when(long, F.concat(F.substring(plain, 1, n), F.lit("\n[truncated]"))).otherwise(plain).alias("text"), F.length(raw).alias("total_chars"), long.alias("truncated"))


def coverage_item(source: Column, retrieved: Column, total: Column, status: Column) -> Column:
    """How much of a source was seen: ``EPMC: 50 of 1,234``, ``CORE: no response``."""
    seen = F.format_number(retrieved, 0)
    of = F.when(total > retrieved, F.concat(F.lit(" of "), F.format_number(total, 0))).otherwise("")
    return F.concat(source, F.lit(": "), F.when(status == "failed", "no response").otherwise(F.concat(seen, of, F.when(status == "partial", " (stopped early)").otherwise(""))))


POLICIES = {"url": sanitize_url, "doi": lambda c: F.when(_c(c).rlike(r"^10\.[0-9]{4,9}/[^\s\"'<>`]+$"), _c(c)), "text": lambda c: sanitize_html(strip_invisible(c)), "json": lambda c: F.when(F.try_parse_json(_c(c)).isNotNull(), F.replace(_c(c), F.lit("<"), F.lit("\\u003c")))}


def sanitized(df: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Each named column under its policy (url, doi, text or json); a value that does not pass becomes null, other columns stay."""
    return df.withColumns({c: POLICIES[p](c) for c, p in policies.items() if c in df.columns})
