"""Scalar text functions as Column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PRAGMA_PREFIXES = ("# type: ignore", "# noqa", "# fmt:", "# pylint:", "# mypy:")
TRAILING_PRAGMA = r"[ \t]*#[ \t]*(?:type:[ \t]*ignore|noqa|fmt:|pylint:|mypy:)[^\n]*"
SECRETS = (
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_pat", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("hex_token", r"\b[0-9a-fA-F]{32,}\b"),
)
KNOWN_HASH_FIELDS = ("manifest_hash", "checkpoint_hash", "tokenizer_hash", "split_hash", "pool_hash", "git_sha", "commit_sha", "chunk_id", "pair_id", "sequence_id")
MAX_STRING_BYTES = 4096
DEBUG_SOURCE_CHARS = 256


def trimmed(text: Column) -> Column:
    """Without white space at both ends; trim() only takes spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def char_shingles(text: Column, n: int = 5) -> Column:
    """The set of n-character runs; a shorter text is its own shingle, an empty or null one has none."""
    length = F.length(text)
    # characters zipped with themselves, shifted: substring() would count from the start each time
    chars = F.split(text, "")
    runs = chars
    for shift in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, shift + 1, F.greatest(length - shift, F.lit(0))), lambda x, y: F.concat(x, y))
    runs = F.filter(runs, lambda r: r.isNotNull())
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.array().cast("array<string>")).when(length < n, F.array(text)).otherwise(F.array_distinct(runs))


def hash32(text: Column) -> Column:
    """The first four bytes of the SHA-1, big-endian."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def unix_lines(text: Column) -> Column:
    """Line ends as \\n, and no white space at line ends."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)[ \t\f\x0B]+$", "")


def without_trailing_pragmas(text: Column) -> Column:
    return F.regexp_replace(text, TRAILING_PRAGMA, "")


def without_pragma_lines(text: Column) -> Column:
    def stays(line: Column) -> Column:
        start = trimmed(line)
        hit = F.lit(False)
        for p in PRAGMA_PREFIXES:
            hit = hit | F.startswith(start, F.lit(p))
        return ~hit

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def without_emails(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, ""), r"[ \t]+", " "), r"\s+$", "")


def redacted(text: Column, field: str | None = None) -> Column:
    """Placeholders for strings over MAX_STRING_BYTES, secrets (not in known hash fields) and email addresses."""
    out = text
    if field not in KNOWN_HASH_FIELDS:
        for name, pattern in SECRETS:
            out = F.regexp_replace(out, pattern, f"<redacted: {name}>")
    out = F.regexp_replace(out, EMAIL, "<redacted: email>")
    return F.when(F.octet_length(text) > MAX_STRING_BYTES, F.lit("<redacted: too_long>")).otherwise(out)


def source_field(text: Column, level: Column) -> Column:
    """A raw-source field in a log record: cut at debug level, dropped above."""
    cut = F.when(F.length(text) <= DEBUG_SOURCE_CHARS, text).otherwise(F.concat(F.substring(text, 1, DEBUG_SOURCE_CHARS), F.lit("…")))
    return F.when(level == "debug", cut).otherwise(F.lit("<redacted: source>"))


def major_version(version: Column) -> Column:
    """v1.2 -> 1; -1 where there is none."""
    return F.coalesce(F.regexp_extract(version, r"^v?(\d{1,9})(?:\.|$)", 1).try_cast("int"), F.lit(-1))


def audit_file_name(repo: Column) -> Column:
    return F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit(".json"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled up to length."""
    return F.slice(F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array_repeat(F.lit(pad), length)), 1, length)


def framed(ids: Column, length: int = 512, first: int = 2, last: int = 3, pad: int = 0) -> Column:
    """[first] ids [last], cut to length and padded."""
    body = F.concat(F.array(F.lit(first)), F.slice(ids, 1, length - 2), F.array(F.lit(last)))
    return padded(body, length, pad)


def dot(a: Column, b: Column) -> Column:
    """In double precision, added in order."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-9) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(floor)))


def hash_uniform(*parts: Column) -> Column:
    """A value in [0, 1) from a digest of the parts: the same in every run, order and engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mean_pooled(states: Column, mask: Column, floor: float = 1e-9) -> Column:
    """The mean of the vectors whose mask is 1, component by component; zeros where the mask is all 0, null without vectors."""
    kept = F.transform(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda p: F.transform(p["v"].cast("array<double>"), lambda x: x * p["m"]))
    start = F.transform(F.try_element_at(states, F.lit(1)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, start, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    count = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(floor)))


def time_ordered_id(at: Column) -> Column:
    """A version 7 id: 48 bits of milliseconds, then random bits with the version and the variant in their places."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    random = F.uuid()
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(random, 16, 3), F.lit("-"), F.substring(random, 20, 17))
