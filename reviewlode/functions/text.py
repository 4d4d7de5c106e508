"""Text scalars: Column to Column, all inside whole-stage code generation.

Null gives null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks of any script, emoji blocks, addresses.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\p{So}]"
BEYOND = r"[\x{2501}-\x{10FFFF}]"
URL = r"(?:https?://|www\.)[^\s]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SENTENCE_END = r"(?<=[.!?।؟])\s+|\n+"
CLAUSE = r"(?<=[.!?।؟])\s+|\n+|,\s+(?=(?:but|and|however|though)\b)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_emoji(c: Column | str) -> Column:
    """Whether emoji would be stripped: only texts with a character beyond U+2500 lose any."""
    c = _col(c)
    return c.rlike(BEYOND) & c.rlike(EMOJI)


def strip_emoji(c: Column | str) -> Column:
    """Text without emoji and other symbols; untouched unless a character beyond U+2500 is present."""
    c = _col(c)
    return F.when(c.rlike(BEYOND), F.regexp_replace(c, EMOJI, "")).otherwise(c)


def emoji_of(c: Column | str) -> Column:
    """The emoji of a text, in order, as one string."""
    c = _col(c)
    return F.when(c.rlike(BEYOND), F.array_join(F.regexp_extract_all(c, F.lit(f"({EMOJI})"), F.lit(1)), "")).otherwise(F.lit(""))


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{BLANK}+", " "))


def clean(c: Column | str) -> Column:
    """Without emoji, addresses and surplus blanks; null counts as empty."""
    t = F.regexp_replace(strip_emoji(F.coalesce(_col(c), F.lit(""))), URL, " ")
    return collapse(F.regexp_replace(t, EMAIL, " "))


def n_words(c: Column | str) -> Column:
    """Words between blanks; 0 for empty text, null for null."""
    c = _col(c)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, r"\s+")))


def _pieces(c: Column, pattern: str) -> Column:
    """Trimmed non-empty pieces; a null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def sentence_array(c: Column | str) -> Column:
    return _pieces(_col(c), SENTENCE_END)


def clause_array(c: Column | str, least: int = 3) -> Column:
    """Sentences cut before ', but / and / however / though'; pieces under ``least`` words are dropped."""
    return F.filter(_pieces(_col(c), CLAUSE), lambda x: F.size(F.split(x, r"\s+")) >= least)


def segment_array(c: Column | str, least: int = 3) -> Column:
    """Segments of a description: lines, sentences and bullets, without bullet marks."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"\n+|(?<=[.!?।؟])\s+|\s*[•●▪✓✔►]\s*")
    bare = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•●▪✓✔►:]+|[\s\-*•●▪✓✔►:]+$", "")))
    return F.filter(bare, lambda x: F.size(F.split(x, r"\s+")) >= least)


def letters(c: Column | str, script: str = r"\p{L}") -> Column:
    """How many letters of a class a text has."""
    c = _col(c)
    return F.length(c) - F.length(F.regexp_replace(c, f"[{script}]", ""))


def script_guess(c: Column | str) -> Column:
    """bn, ar or en by the script with most letters, ties in that order; unk without any."""
    bn, ar, en = letters(c, r"\x{980}-\x{9FF}"), letters(c, r"\x{600}-\x{6FF}"), letters(c, "A-Za-z")
    return F.when(_col(c).isNull() | (F.greatest(bn, ar, en) == 0), "unk").when((bn >= ar) & (bn >= en), "bn").when(ar >= en, "ar").otherwise("en")


def latin_ratio(c: Column | str) -> Column:
    """Share of a text's letters that are Latin; 0 without letters."""
    total = letters(c)
    return F.when(total == 0, 0.0).otherwise(letters(c, r"A-Za-z\x{C0}-\x{24F}") / total)


def looks_translated(source: Column | str, out: Column | str, share: float = 0.5) -> Column:
    """Whether a translation's output is one: not blank, not the source again, mostly Latin."""
    out = _col(out)
    return F.coalesce((F.trim(out) != "") & (F.trim(out) != F.trim(_col(source))) & (latin_ratio(out) >= share), F.lit(False))


def devotional_share(c: Column | str, pattern: str) -> Column:
    """Share of letters left after devotional phrases are removed; 0 without letters."""
    c = _col(c)
    total = letters(c)
    return F.when(total == 0, 0.0).otherwise(letters(F.regexp_replace(c, pattern, "")) / total)


def app_key(c: Column | str) -> Column:
    """Lower-case letters, digits and underscores of a name."""
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_]", "")


def brand_lead(c: Column | str) -> Column:
    """The key of what stands before a dash, colon or bracket in a name."""
    return app_key(F.regexp_extract(_col(c), r"^([^–—\-:|(]*)", 1))


def _unaccented() -> tuple[str, str]:
    """Accented Latin letters and the bare ones, by decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250) if unicodedata.decomposition(chr(i)) and unicodedata.normalize("NFKD", chr(i))[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


UNACCENTED = _unaccented()


def safe_dirname(c: Column | str, most: int = 80) -> Column:
    """A name as a folder name: letters without accents and word characters, blanks as underscores, at most ``most`` characters."""
    plain = F.translate(_col(c), *UNACCENTED)
    bare = F.regexp_replace(F.trim(F.regexp_replace(plain, r"[^A-Za-z0-9_\s\-]", "")), r"\s+", "_")
    return F.substring(bare, 1, most)


def package_id(package: Column | str, link: Column | str) -> Column:
    """A store package id: the one given, else the id of the link's query."""
    return F.coalesce(F.nullif(F.trim(_col(package)), F.lit("")), F.expr(f"try_parse_url({link if isinstance(link, str) else 'link'}, 'QUERY', 'id')"))


def install_tier(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n > 100_000_000, "100M+").when(n > 10_000_000, "10M+").when(n > 1_000_000, "1M+").otherwise("<1M")


def star_band(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s <= 2, "low").when(s == 3, "mid").when(s >= 4, "high")


def star_label(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s <= 2, "Negative").when(s == 3, "Neutral").when(s >= 4, "Positive")
