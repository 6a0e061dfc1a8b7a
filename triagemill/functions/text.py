"""Text expressions. Null text is the empty string throughout.

``WORD`` and ``SPACE`` are spelled out as Unicode classes because Java's ``\\w`` and ``\\s``
are ASCII-only by default and its Unicode mode counts combining marks as word characters.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: character classes and patterns
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
OTHER_SPACE = SPACE.replace(r"\x{20}", r"\x{1f}")
NON_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
URL = rf"(?i)(https?://{NON_SPACE}+|www\.{NON_SPACE}+)"
URL_WORDS = ("http://", "https://", "www.")
EMAIL_UNICODE = r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
EMAIL_ASCII = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
# a run of non-blanks that holds an @, whole; a run is looked at from its beginning only
EMAIL_LOOSE = rf"(?<!{NON_SPACE}){NON_SPACE[:-1]}@]*+@{NON_SPACE}*+"
HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"(?U)&\w+;"
CODE_BLOCK = r"(?s)```.*?```"
STACK_LINE = (
    rf"(?i)(^{SPACE}*at{SPACE}+{NON_SPACE}+|Exception in thread|"
    r"Traceback \(most recent call last\):)"
)
CODE_WORDS = ("```", "Traceback (", "Exception in thread")
CODE_MARK = rf"(?m)^{SPACE}*at{SPACE}+{NON_SPACE}+"
ISSUE_ID = rf"(?iU)\b(?:bug{SPACE}*#?|issue{SPACE}*#?|bz{SPACE}*#?)\d{{3,}}\b"
BUG_REFERENCE = rf"(?iU)\b(?:bug|issue|bz){SPACE}*#?{SPACE}*\d+\b"
LONG_HEX = r"(?iU)\b(?:0x)?[0-9a-f]{10,}\b"
LABEL_TERM = r"(?iU)\b(blocker|critical|major|normal|minor|trivial|severity)\b"
STACK_FRAME = rf"(?i)(?:^|\n){SPACE}*at{SPACE}+[\p{{L}}\p{{N}}_.$]+\([^\n]+\)"
CODE_LINE = rf"(?i)([{{}};]|(?:^|\n){SPACE}*(?:public|private|class|def|if|for)\b)"
# printable ASCII, which most characters are, is refused first
LINE_BREAK = r"(?![ -~])(?:\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"
REPEATED = r"(.)\1{3,}"
# fixed value: decimal digits, and the other characters that count as digits
DIGIT = (
    r"[\p{Nd}"
    r"\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
    r"]"
)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    return strip(text_or_empty(col)) == ""


def collapse(col: Column) -> Column:
    """Runs of blanks become one blank; single blanks, which stay, are no matches."""
    return F.regexp_replace(col, f"(?![!-~])(?:{OTHER_SPACE}{SPACE}*| {SPACE}+)", " ")


def token_count(col: Column) -> Column:
    """Number of whitespace-separated tokens: the blanks between them and one more."""
    flat = F.btrim(collapse(col))
    between = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return (between + (flat != "").cast("int")).cast("bigint")


def whitespace_tokens(col: Column) -> Column:
    # cutting at blanks is several times faster than extracting what lies between them
    return F.filter(F.split(col, SPACE + "+"), lambda x: x != "")


TEXTS_AT_ONCE = 64


def _mapped(values: pa.Array, rule: Callable[[str], str]) -> pa.Array:
    """``rule`` of every text. Few texts at a time are Python strings, the rest stays in Arrow."""
    parts = []
    for at in range(0, len(values), TEXTS_AT_ONCE):
        texts = values.slice(at, TEXTS_AT_ONCE).to_pylist()
        parts.append(pa.array([None if x is None else rule(x) for x in texts], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _nfkc_then_unescape(values: pa.Array) -> pa.Array:
    return _mapped(values, lambda x: html.unescape(unicodedata.normalize("NFKC", x)))


@F.arrow_udf(StringType())
def _unescape_then_nfkc(values: pa.Array) -> pa.Array:
    return _mapped(values, lambda x: unicodedata.normalize("NFKC", html.unescape(x)))


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return _mapped(values, lambda x: unicodedata.normalize("NFKC", x))


@F.arrow_udf(StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return _mapped(values, html.unescape)


def _only_where(col: Column, pattern: str, udf) -> Column:
    """Ship to Python only the texts that ``pattern`` says can change."""
    return F.coalesce(udf(F.when(col.rlike(pattern), col)), col)


_NOT_ASCII = r"[^\x00-\x7f]"
_NOT_ASCII_OR_ENTITY = r"[^\x00-\x7f]|&"


def nfkc(col: Column) -> Column:
    return _only_where(col, _NOT_ASCII, _nfkc)


@dataclass(frozen=True)
class CleaningOptions:
    lowercase: bool = True
    remove_html: bool = True
    replace_urls: bool = True
    replace_emails: bool = True
    remove_code_blocks: bool = False
    remove_stack_traces: bool = False
    normalize_unicode: bool = True
    normalize_whitespace: bool = True


def clean_text(col: Column, options: CleaningOptions = CleaningOptions()) -> Column:
    """The configurable cleaner; placeholders stay upper-case since lower-casing runs first."""
    return _cleaned(decoded(col, options), options)


def decoded(col: Column, options: CleaningOptions = CleaningOptions()) -> Column:
    """The first steps of the cleaner: Unicode forms and entities."""
    text = text_or_empty(col)
    if options.normalize_unicode:
        return _only_where(text, _NOT_ASCII_OR_ENTITY, _nfkc_then_unescape)
    return _only_where(text, "&", _unescape)


def clean_representations(summary: Column, description: Column, names: list[str]) -> dict[str, Column]:
    """``clean_text(combine(...))`` by name, each field decoded once for all of them.

    Neither composition nor an entity crosses the blanks that ``combine`` puts between the fields.
    """
    s, d, options = decoded(summary), decoded(description), CleaningOptions()
    return {x: _cleaned(combine(s, d, x), options) for x in names}


def _cleaned(text: Column, options: CleaningOptions) -> Column:
    if options.remove_code_blocks:
        text = F.regexp_replace(text, CODE_BLOCK, " ")
    if options.remove_stack_traces:
        text = F.regexp_replace(text, STACK_LINE, " ")
    if options.remove_html:
        text = F.regexp_replace(text, HTML_TAG, " ")
    if options.lowercase:
        text = F.lower(text)
    if options.replace_urls:
        text = F.regexp_replace(text, URL, " [URL] ")
    if options.replace_emails:
        text = F.regexp_replace(text, EMAIL_UNICODE, " [EMAIL] ")
    if options.normalize_whitespace:
        text = collapse(text)
    return strip(text)


def combine(summary: Column, description: Column, representation: str) -> Column:
    if representation == "summary":
        return text_or_empty(summary)
    if representation == "description":
        return text_or_empty(description)
    if representation == "summary_description":
        return F.concat_ws(" \n ", text_or_empty(summary), text_or_empty(description))
    raise ValueError(f"Unsupported representation: {representation}")


def tagged_clean(summary: Column, description: Column, mask_labels: bool = False) -> Column:
    """Field-tagged cleaner; lower-casing runs last, so placeholders end lower-case."""
    text = F.concat(
        F.lit("[SUMMARY] "),
        text_or_empty(summary),
        F.lit(" [DESCRIPTION] "),
        text_or_empty(description),
    )
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    text = _only_where(text, _NOT_ASCII_OR_ENTITY, _unescape_then_nfkc)
    for pattern, mark in (
        (HTML_TAG, " "),
        (URL, " [URL] "),
        (EMAIL_ASCII, " [EMAIL] "),
        (ISSUE_ID, " [ISSUE_ID] "),
        (LONG_HEX, " [HEX] "),
    ):
        text = F.regexp_replace(text, pattern, mark)
    if mask_labels:
        text = F.regexp_replace(text, LABEL_TERM, " [SEVERITY_TERM] ")
    return F.lower(strip(collapse(text)))


def joined(summary: Column, description: Column, sep: str = "\n") -> Column:
    return F.concat_ws(sep, text_or_empty(summary), text_or_empty(description))


def exact_text_hash(summary: Column, description: Column) -> Column:
    return F.sha2(strip(collapse(F.lower(joined(summary, description)))), 256)


def raw_text_hash(summary: Column, description: Column) -> Column:
    return F.sha2(joined(summary, description), 256)


def normalized_text_hash(summary: Column, description: Column) -> Column:
    return F.sha2(tagged_clean(summary, description), 256)


def redact(col: Column, limit: int | None = None, email: str = EMAIL_LOOSE) -> Column:
    """Mask e-mails then URLs, then cut. Only texts with an @ are searched for e-mails."""
    text = text_or_empty(col)
    text = F.when(text.contains("@"), F.regexp_replace(text, email, "[EMAIL]")).otherwise(text)
    masked = F.regexp_replace(text, URL, "[URL]")
    return masked if limit is None else F.substring(masked, 1, limit)


def cut_then_redact(col: Column, limit: int) -> Column:
    return redact(F.substring(text_or_empty(col), 1, limit))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def audit_indicators(text: Column) -> dict[str, Column]:
    """Fixed words are looked for as such, patterns only where they can match."""
    return {
        "has_url": _holds(F.lower(text), URL_WORDS),
        "has_email": text.contains("@") & text.rlike(EMAIL_UNICODE),
        "has_html": text.rlike(HTML_TAG),
        "has_code": _holds(text, CODE_WORDS) | text.rlike(CODE_MARK),
    }


def study_indicators(text: Column) -> dict[str, Column]:
    return {
        "html": text.rlike(HTML_TAG),
        "html_entity": text.rlike(HTML_ENTITY),
        "code": text.rlike(CODE_LINE),
        "stack_trace": text.rlike(STACK_FRAME),
        "url": text.rlike(URL),
        "email": text.contains("@") & text.rlike(EMAIL_ASCII),
        "bug_reference": text.rlike(BUG_REFERENCE),
        "long_hex": text.rlike(LONG_HEX),
    }


def structural_features(summary: Column, description: Column) -> dict[str, Column]:
    """The 23 structural measurements of one report."""
    s, d = text_or_empty(summary), text_or_empty(description)
    text = F.concat_ws("\n", s, d)
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, LINE_BREAK)
    # a final line break opens no further line
    ended = F.substring(text, -1, 1).rlike(LINE_BREAK).cast("int")
    # the long class is asked about other characters than ASCII only
    digits = F.regexp_count(text, F.lit(rf"[0-9]|(?=[^\x00-\x7f]){DIGIT}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))

    def flag(pattern: str) -> Column:
        return text.rlike(pattern).cast("int")

    columns = {
        "summary_chars": F.length(s),
        "summary_tokens": token_count(s),
        "description_chars": F.length(d),
        "description_tokens": token_count(d),
        "combined_chars": F.length(text),
        # the line break between the two ends a token
        "combined_tokens": token_count(s) + token_count(d),
        "line_count": F.size(lines) - ended,
        "description_empty": is_blank(d).cast("int"),
        "digit_count": digits,
        "digit_ratio": digits / size,
        "upper_count": upper,
        "upper_ratio": upper / size,
        "punctuation_count": F.regexp_count(
            text, F.lit(rf"(?![A-Za-z0-9 ])[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]")
        ),
        "exclamation_count": F.regexp_count(text, F.lit("!")),
        "question_count": F.regexp_count(text, F.lit(r"\?")),
        "code_lines": F.size(F.filter(lines, lambda line: line.rlike(CODE_LINE))),
        "has_stack_trace": flag(STACK_FRAME),
        "has_url": flag(URL),
        "has_email": (text.contains("@") & text.rlike(EMAIL_ASCII)).cast("int"),
        "has_html": flag(HTML_TAG),
        "has_bug_reference": flag(BUG_REFERENCE),
        "has_long_hex": flag(LONG_HEX),
        "has_repeated_character": flag(REPEATED),
    }
    return {name: col.cast("double") for name, col in columns.items()}


def word_tokens(col: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(f"({WORD}{{2,}})"), F.lit(1))


def _word_grams(tokens: Column, n: int) -> Column:
    """Shifted copies zipped together: linear in the number of tokens."""
    last = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), last)
    for shift in range(1, n):
        following = F.slice(tokens, F.lit(shift + 1), last)
        grams = F.zip_with(grams, following, lambda a, b: F.concat_ws(" ", a, b))
    return grams


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All word n-grams with low <= n <= high, joined by one blank."""
    parts = [tokens if n == 1 else _word_grams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _char_grams(words: Column, n: int) -> Column:
    def of_word(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.flatten(F.transform(words, of_word))


def char_ngrams(col: Column, low: int, high: int) -> Column:
    """Character n-grams of the whole text with runs of blanks collapsed."""
    flat = collapse(F.lower(text_or_empty(col)))
    return F.concat(
        *[
            F.when(F.length(flat) >= n, _char_grams(F.array(flat), n)).otherwise(
                F.array().cast("array<string>")
            )
            for n in range(low, high + 1)
        ]
    )


def _at_least(words: Column, n: int) -> Column:
    return F.filter(words, lambda word: F.length(word) >= n)


def char_wb_ngrams(col: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words.

    A word shorter than n + 1 counts whole and takes part in no longer n.
    """
    words = F.transform(
        whitespace_tokens(F.lower(text_or_empty(col))),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )
    parts = [
        _char_grams(words if n == low else _at_least(words, n), n) for n in range(low, high + 1)
    ]
    return F.concat(*parts)


def length_bucket(length: Column) -> Column:
    return (
        F.when(length <= 200, "short").when(length <= 1000, "medium").otherwise("long")
    )
