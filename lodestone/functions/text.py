"""Text expressions: cleaning, statistics, sentences, negation marks. All are Columns, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
URL = r"https?://\S+|www\.\S+"
DROPPED_ELEMENTS = ("iframe", "script", "a")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
#: Unicode spaces, as Java, RE2 and Python all understand them.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Irregular contractions first, then endings.
CONTRACTIONS = (
    (r"(?i)\bwon['’]t\b", "will not"), (r"(?i)\bcan['’]t\b", "cannot"), (r"(?i)\bshan['’]t\b", "shall not"), (r"(?i)\bain['’]t\b", "are not"), (r"(?i)\blet['’]s\b", "let us"), (r"(?i)\by['’]all\b", "you all"),
    (r"(?i)\b(it|he|she|that|what|there|who|here|where)['’]s\b", "$1 is"), (r"(?i)([a-z])n['’]t\b", "$1 not"), (r"(?i)\b(i)['’]m\b", "$1 am"),
    (r"(?i)([a-z])['’]re\b", "$1 are"), (r"(?i)([a-z])['’]ve\b", "$1 have"), (r"(?i)([a-z])['’]ll\b", "$1 will"), (r"(?i)([a-z])['’]d\b", "$1 would"),
)
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ‘’“”–—"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy''\"\"--"
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
NEGATORS = ("not", "no", "nor", "never")
#: Abbreviations whose period does not end a sentence, matched as they stand.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Mt.", "vs.", "etc.", "e.g.", "i.e.")
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split()
)
# --- end of fixed values ---


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def strip_html(x: Column) -> Column:
    """Text of an HTML fragment: iframe, script and a are dropped with their contents, other tags only themselves."""
    for tag in DROPPED_ELEMENTS:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[a-zA-Z/!][^>]*>", " ")
    for k, v in ENTITIES.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def strip_urls(x: Column) -> Column:
    return F.regexp_replace(x, URL, "")


def unify_newlines(x: Column, to: str = " ") -> Column:
    return F.regexp_replace(x, r"\r\n?|\n", to)


def expand_contractions(x: Column) -> Column:
    for pattern, full in CONTRACTIONS:
        x = F.regexp_replace(x, pattern, full)
    return x


def transliterate(x: Column) -> Column:
    """Latin-1 letters without their marks, typographic quotes and dashes as ASCII; other scripts stay."""
    x = F.translate(x, ACCENTED, PLAIN)
    for k, v in LIGATURES.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def clean_text(x: Column, html: bool = True, contractions: bool = True, unicode: bool = True, lowercase: bool = True, null_as: str | None = "None") -> Column:
    """HTML and links out, newlines to spaces, contractions expanded, transliterated, lower case, spaces collapsed.

    A null text becomes ``null_as`` first (None: stays null), so that the minimum-words filter drops it.
    """
    x = x.cast("string")
    if null_as is not None:
        x = F.coalesce(x, F.lit(null_as))
    if html:
        x = strip_html(x)
    x = unify_newlines(strip_urls(x))
    if contractions:
        x = expand_contractions(x)
    if unicode:
        x = transliterate(x)
    if lowercase:
        x = F.lower(x)
    return collapse_spaces(x)


def words(x: Column) -> Column:
    """Whitespace-separated words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), SPACE), lambda w: F.length(w) > 0)


def word_count(x: Column) -> Column:
    return F.size(words(x))


def sentence_count(x: Column) -> Column:
    """Number of '.', '!' and '?', at least 1."""
    t = F.coalesce(x, F.lit(""))
    return F.greatest(F.lit(1), F.length(t) - F.length(F.regexp_replace(t, "[.!?]", "")))


def average_word_length(x: Column) -> Column:
    w = words(x)
    return F.when(F.size(w) > 0, F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, b: a + b) / F.size(w)).otherwise(F.lit(0.0))


def sentence_units(x: Column, min_chars: int = 10) -> Column:
    """Sentences as an array: split after . ! ? before a capital, digit or quote; abbreviations protected; short ones dropped."""
    mark = "\x01"
    t = collapse_spaces(F.coalesce(x, F.lit("")))
    for a in ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", mark)))
    t = F.regexp_replace(t, r"([.!?])\s+([A-Z0-9\"'])", "$1\x02$2")
    parts = F.transform(F.split(t, "\x02"), lambda s: F.trim(F.replace(s, F.lit(mark), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def mark_negation(tokens: Column, scope: int = 0, negators: Sequence[str] = NEGATORS) -> Column:
    """Tokens with ``NOT_t`` marks for the next ``scope`` tokens after each negator that are no negators; 0 leaves them alone.

    Negators in between are passed over and do not use up the scope. The marks stand right after the negator, and the
    tokens themselves stay too. A null array stays null.
    """
    if scope <= 0:
        return tokens
    neg = F.array(*[F.lit(n) for n in negators])
    rest = lambda i: F.filter(F.slice(tokens, i + 2, F.greatest(F.size(tokens), F.lit(0))), lambda u: ~F.array_contains(neg, u))
    marked = F.transform(
        tokens,
        lambda t, i: F.when(F.array_contains(neg, t), F.concat(F.array(t), F.transform(F.slice(rest(i), 1, scope), lambda u: F.concat(F.lit("NOT_"), u)))).otherwise(F.array(t)),
    )
    return F.flatten(marked)


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS, keep: Sequence[str] = NEGATORS) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words if w not in keep])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def term_tokens(x: Column, pattern: str = "[a-z_]{2,}", stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens (runs of letters, digits, marks and _) that match ``pattern`` as a whole, without stop words."""
    t = F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\p{M}_]+"), lambda w: w.rlike(f"^(?:{pattern})$"))
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        t = F.filter(t, lambda w: ~F.array_contains(stop, w))
    return t


def with_bigrams(tokens: Column) -> Column:
    """The tokens and each pair of neighbours."""
    pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", F.element_at(tokens, i + 1), t))
    return F.concat(tokens, pairs)


def shorten(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def year_of(x: Column) -> Column:
    """The year in a date of any notation, null if there is none."""
    y = F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"((?:19|20)\d\d)", 1)
    return F.when(y != "", y.cast("int"))


def month_label(ts: Column) -> Column:
    """'YYYY-MM', or 'NaT' for a date that is missing or cannot be read."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("NaT"))
