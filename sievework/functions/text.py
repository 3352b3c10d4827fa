"""Column functions over text. Patterns follow the Unicode dialect: rx() turns one into its Java form."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, fold: bool = True) -> str:
    """The Java form of a pattern whose classes and boundaries are Unicode-aware, ignoring case if fold."""
    return ("(?iuU)" if fold else "(?U)") + pattern


def has(text: Column, *patterns: str, fold: bool = True) -> Column:
    """Does any pattern occur? They are compiled into one alternation, so a text is scanned once."""
    return F.coalesce(text, F.lit("")).rlike(rx("|".join(f"(?:{p})" for p in patterns), fold))


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [has(text, p).cast("int") for p in patterns], F.lit(0))


def words_pattern(words) -> str:
    """Any of the words, bounded."""
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).contains(t) for t in terms], F.lit(False))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(text: Column, chars: str = "a-zà-ÿ") -> Column:
    """Lower-case letter runs of a text."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(f"[{chars}]+"), F.lit(0))


def count_of(words: Column, listed) -> Column:
    """How many elements of an array of words, with multiplicity, are in the list."""
    bag = F.array(*[F.lit(w) for w in sorted(listed)])
    return F.size(F.filter(words, lambda w: F.array_contains(bag, w)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(blank(text), rx(r"\s+", False), " "))


def cut(text: Column, most: int = 255) -> Column:
    """Trimmed, cut to so many characters, trimmed again."""
    return F.trim(F.substring(F.trim(text), 1, most))


def posting_text(title: Column, description: Column) -> Column:
    return F.concat(F.lit("TITLE: "), blank(title), F.lit("\n\n"), blank(description))


def fingerprint(title: Column, company: Column, remote: Column, kind: Column | None = None) -> Column:
    """SHA-256 of the normalized title, company and remote flag; a kind other than 'job' is put before them."""
    squeeze = lambda c: F.regexp_replace(F.lower(F.trim(blank(c))), rx(r"\s+", False), " ")
    place = F.when(F.coalesce(remote, F.lit(False)), "remote").otherwise("onsite")
    plain = F.concat_ws("|", squeeze(title), squeeze(company), place)
    if kind is not None:
        plain = F.when(kind.isNotNull() & (kind != "job"), F.concat_ws("|", kind, plain)).otherwise(plain)
    return F.sha2(plain, 256)


def content_hash(title: Column, company: Column, description: Column) -> Column:
    return F.sha2(F.trim(F.concat_ws("\n", blank(title), blank(company), blank(description))), 256)


def slug(text: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def group_key(company: Column, title: Column) -> Column:
    return F.concat_ws("|", slug(company), slug(title))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(blank(url), "/+$", ""), "/"), -1)


def listing_number(url: Column) -> Column:
    """The number of four digits or more that ends the last path segment, null if none."""
    return F.nullif(F.regexp_extract(last_segment(url), r"-(\d{4,})$", 1), F.lit(""))


def listing_key(url: Column) -> Column:
    """The numeric suffix of the last path segment, or the segment."""
    return F.regexp_replace(last_segment(url), r"^.*-(\d+)$", "$1")


def repo_of(url: Column) -> Column:
    """The last two path parts of a repository address."""
    parts = F.filter(F.split(blank(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(blank(url))


def issue_title(title: Column) -> Column:
    """One leading tag prefix, hex ids, digits and everything but letters stripped; spaces collapsed."""
    t = F.lower(blank(title))
    for pattern in (r"^\s*(?:\[[^\]]*\]|\([^)]*\)|[a-z]+\s*:)\s*", r"\b0x[0-9a-f]+\b|\b[0-9a-f]{7,}\b", r"[0-9]+", r"[^a-zà-ÿ]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, " +", " "))


#: Currency symbols and codes, and the forms of an amount.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
MONEY = r"[$€£₹]\s*\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s*[kK]?\s*(?:USD|EUR|GBP|INR)"


def money(text: Column) -> Column:
    """array<struct<amount, currency>> of all amounts in order; a k after a number is read over."""
    found = F.regexp_extract_all(blank(text), F.lit("(?i)" + MONEY), F.lit(0))
    amount = lambda m: F.regexp_replace(F.regexp_extract(m, r"\d[\d,]*(?:\.\d{1,2})?", 0), ",", "").try_cast("double")
    first = lambda m: F.substring(m, 1, 1)

    def currency(m: Column) -> Column:
        out = F.upper(F.substring(m, -3, 3))
        for symbol, code in CURRENCIES.items():
            out = F.when(first(m) == symbol, code).otherwise(out)
        return out

    return F.filter(F.transform(found, lambda m: F.struct(amount(m).alias("amount"), currency(m).alias("currency"))), lambda x: x["amount"].isNotNull())


def salary_top(text: Column) -> Column:
    """The largest whole number in a text, commas dropped; 0 if none."""
    found = F.regexp_extract_all(blank(text), F.lit(r"\d[\d,]*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long"))), F.lit(0))


#: Addresses that are no contact.
JUNK_MAIL = ("example.com", "noreply", "no-reply", "sentry.io", ".png", ".jpg")


def email(text: Column) -> Column:
    """The first e-mail address that holds no junk mark; null if none."""
    found = F.regexp_extract_all(blank(text), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    kept = F.filter(found, lambda x: ~contains_any(F.lower(x), JUNK_MAIL))
    return F.when(F.size(kept) > 0, kept[0])


def company(name: Column) -> Column:
    c = F.lower(F.trim(blank(name)))
    return F.when(c.isin("unknown", "n/a", "none", "na", "null"), "").otherwise(c)


def snippet(text: Column, most: int = 200) -> Column:
    return collapse(F.substring(blank(text), 1, most))


def strip_tags(html: Column) -> Column:
    """Tags as spaces, white space collapsed: the form that a pattern can give."""
    return collapse(F.regexp_replace(blank(html), "<[^>]+>", " "))


#: Addresses of applicant tracking systems, in order of preference.
TRACKERS = (r"https?://(?:boards\.greenhouse\.io|job-boards\.greenhouse\.io|grnh\.se)/[^\s\"'<>]+", r"https?://jobs\.lever\.co/[^\s\"'<>]+", r"https?://jobs\.ashbyhq\.com/[^\s\"'<>]+", r"https?://apply\.workable\.com/[^\s\"'<>]+")


def tracker_link(*texts: Column) -> Column:
    """The first tracking-system address, by order of pattern and then of text, without trailing punctuation."""
    found = [F.nullif(F.regexp_extract(blank(t), p, 0), F.lit("")) for t in texts for p in TRACKERS]
    return F.regexp_replace(F.coalesce(*found), r"[.,;:)\]]+$", "")


#: Phrases that tie a posting to one country.
COUNTRY_LOCK = r"\b(must (?:be )?(?:reside|live|located|based) in|authori[sz]ed to work in|us citizen|green card|w-?2 only|security clearance)\b"


def country_lock(text: Column) -> Column:
    return F.nullif(F.regexp_extract(blank(text), rx(COUNTRY_LOCK), 0), F.lit(""))


def instant(text: Column) -> Column:
    """A timestamp from an epoch number (seconds or milliseconds), ISO or RFC 2822 text; null if none of them."""
    t = F.trim(text.cast("string"))
    number = t.try_cast("double")
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    plain = F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, *", ""), "(GMT|UTC)$", "+0000")
    rfc = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])
    return F.when(number.isNotNull(), epoch).otherwise(F.coalesce(t.try_cast("timestamp"), rfc))


#: Characters that a wrong decoding leaves, with what they were.
MOJIBAKE = (("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€“", "–"), ("â€”", "—"), ("â€¢", "•"), ("â€¦", "…"), ("Â\xa0", " "), ("Â", ""))


def unscramble(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252: frequent remains are replaced, then all two-byte letters."""
    t = blank(text)
    for wrong, right in MOJIBAKE[:-2]:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    fixed = t
    for code in range(0x80, 0xC0):
        fixed = F.replace(F.replace(fixed, F.lit("Ã" + chr(code)), F.lit(chr(code + 0x40))), F.lit("Â" + chr(code)), F.lit(chr(code)))
    return F.when(t.rlike("[ÂÃ][\\x80-\\xbf]"), fixed).otherwise(t)  # few texts take the long way


def job_type(text: Column) -> Column:
    t = F.lower(blank(text))
    return (
        F.when(t.rlike("intern|werkstudent|praktik"), "internship")
        .when(t.rlike("contract|freelance|temporary"), "contract")
        .when(t.rlike("part"), "part_time")
        .when(t.rlike("full|permanent"), "full_time")
        .otherwise("other")
    )
