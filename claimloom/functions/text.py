"""Text cleaning as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.resources.words import DEBUNKERS, STOP_WORDS

BLANKS = r"^\s+|\s+$"
#: Typographic signs and their plain forms; and how they look when UTF-8 was read as Latin-1.
SMART, PLAIN = "‘’“”，", "''\"\","
MOJIBAKE = (("\xe2\x80\x9c", "'"), ("\xe2\x80\x9d", "'"), ("\xe2\x80\x99", "'"), ("\xe2\x80\xa6", "..."), ("\xe2\x80\x93", "-"))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(col(c), BLANKS, "")


def words(c) -> Column:
    """Words parted by white space; none for an empty text."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def clean_str(c) -> Column:
    """TXT-01: letters, digits and white space alone, stripped, lower case."""
    return F.lower(strip(F.regexp_replace(col(c), r"[^0-9A-Za-z\s]", "")))


def clean_quotes(c) -> Column:
    """TXT-02: without backslash and quotes, stripped, lower case."""
    return F.lower(strip(F.translate(col(c), "\\'\"", "")))


def ascii_only(c) -> Column:
    """TXT-03."""
    return F.regexp_replace(col(c), r"[^\x00-\x7F]", "")


def plain_quotes(c) -> Column:
    """TXT-04: sign by sign, since each is rare and a search costs less than a lookup of every sign."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), zip(SMART, PLAIN), col(c))


def fix_mojibake(c) -> Column:
    """TXT-05."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), MOJIBAKE, col(c))


def mask_emails(c) -> Column:
    """TXT-06."""
    return F.regexp_replace(col(c), r"(?<![\w.-])[\w.-]++@[\w.-]+", "_EMAIL_")


def mask_links(c) -> Column:
    """TXT-07: a link's closing full stop or comma stays (its own, not an earlier link's)."""
    kept = F.regexp_replace(col(c), r"http\S*([.,])(\s|$)", "_LINKS_$1$2")
    return F.regexp_replace(kept, r"http\S+", "_LINKS_")


def question_marks(c) -> Column:
    """TXT-08: question marks that stand for lost signs."""
    return F.regexp_replace(col(c), r"\?(\w+)\? | (\w+)\?\w+", "$1$2")


def drop_bracketed(c) -> Column:
    """TXT-09: the first (word) and the first [word] among the first ten words, wherever they occur.

    Nothing is found as an empty string, which ``replace`` leaves alone; so the text is named three times, without conditions.
    """
    head = F.regexp_extract(col(c), r"^\s*+(?:\S++\s++){0,9}+\S*+", 0)
    found = [F.regexp_extract(head, pattern, 0) for pattern in (r"\(\w+\)", r"\[\w+\]")]
    return reduce(lambda out, x: F.replace(out, x, F.lit("")), found, col(c))


def clean_claim_example(c) -> Column:
    """TXT-10."""
    return strip(F.replace(col(c), F.lit("SeeExample( s )"), F.lit("")))


def clean_text(c, order: str = "web") -> Column:
    """TXT-11: all of the above; ``cli`` strips to ASCII first, ``web`` mends signs first."""
    out = ascii_only(c) if order == "cli" else ascii_only(fix_mojibake(plain_quotes(c)))
    if order == "cli":
        out = plain_quotes(out)
    for step in (mask_emails, mask_links, question_marks, drop_bracketed):
        out = step(out)
    return out


def to_paragraphs(c) -> Column:
    """TXT-12: escaped text, each line a paragraph."""
    escaped = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit("<p>"), F.regexp_replace(escaped, r"\n+", "</p><p>"), F.lit("</p>"))


def from_paragraphs(c) -> Column:
    """TXT-13."""
    return F.regexp_replace(col(c), "</?p>", " ")


def drop_tabs(c) -> Column:
    """TXT-14."""
    return F.replace(col(c), F.lit("\t"), F.lit(""))


def collapse(c) -> Column:
    """TXT-15."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def for_transformer(c) -> Column:
    """TXT-16: text for a transformer's tokenizer; stop words go, but for not and can."""
    s = F.replace(collapse(c), F.lit("&amp;"), F.lit("&"))
    s = F.replace(s, F.lit("'t"), F.lit(" not"))
    s = F.regexp_replace(s, r"@.*?\s", " ")
    s = F.regexp_replace(s, r"(['\".()!?\\/,])", " $1 ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s?]", " ")
    stop = [w for w in STOP_WORDS if w not in ("not", "can")]
    return F.array_join(F.filter(words(s), lambda w: ~w.isin(stop)), " ")


def for_topics(c) -> Column:
    """TXT-17: lower case, without stop words, then without punctuation (a lemma table joins on the words)."""
    kept = F.array_join(F.filter(words(F.lower(col(c))), lambda w: ~w.isin(STOP_WORDS)), " ")
    return F.regexp_replace(kept, r"[!-/:-@\[-`{-~]", "")


def lower_strip(c) -> Column:
    """TXT-18."""
    return F.lower(strip(c))


def subject(c) -> Column:
    """TXT-19: a text's first hundred characters stand for its subject."""
    return F.substring(col(c), 1, 100)


def prefix(c, n: int = 7) -> Column:
    """TXT-20."""
    return F.substring(col(c), 1, n)


def shorten(c, n: int = 80) -> Column:
    """TXT-21."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n - 3), F.lit("..."))).otherwise(col(c))


def is_ascii(c) -> Column:
    """TXT-22."""
    return ~col(c).rlike(r"[^\x00-\x7F]")


def letters_only(c) -> Column:
    """TXT-23."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z]", "")


def count_words(c) -> Column:
    """TXT-24: words with a letter, counted at the first letter of each."""
    return F.regexp_count(F.lower(col(c)), F.lit(r"(?<!\S)[^\sa-z]*+[a-z]")).cast("long")


def from_debunker(c) -> Column:
    """URL-06."""
    return reduce(lambda a, b: a | b, [col(c).contains(w) for w in DEBUNKERS])
