"""Text expressions: lines, equal-length masking, search terms."""
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let

# Secret-bearing text. Each entry is (pattern, group layout); a three-group pattern keeps its first and
# third group and masks the second, a plain pattern is masked whole.
PRIVATE_KEY = (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?"
               r"-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----")
TOKEN = (r"(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AIza[A-Za-z0-9_-]{30,}"
         r"|AKIA[A-Z0-9]{16}|sk-[A-Za-z0-9_-]{24,})")
ASSIGNMENT = (r"(?i)(?=[asp])((?:api[_-]?key|secret|password|access[_-]?token)\s*[:=]\s*[\"'])([^\"'\r\n]{12,})([\"'])")
ELEMENT = (r"(?i)(<(?:api[_-]?key|secret|password|token)>\s*)([^<\r\n]{12,})"
           r"(\s*</(?:api[_-]?key|secret|password|token)>)")
SECRET_PATTERNS = [(PRIVATE_KEY, False), (TOKEN, False), (ASSIGNMENT, True), (ELEMENT, True)]
# One of these stands in every match of the pattern; a text without any is not searched.
SECRET_MARKS = {PRIVATE_KEY: ["-----BEGIN "], TOKEN: ["gh", "AIza", "AKIA", "sk-"], ELEMENT: ["<"]}

# Line separators recognised besides CR LF.
LINE_BREAKS = r"\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
LINE_END = f"(?<=[{LINE_BREAKS}])(?<!\\r(?=\\n))"     # behind a separator, not inside CR LF


def lines_with_ends(content: Column) -> Column:
    """Lines of a text with their terminators; their concatenation is the text."""
    return F.array_remove(F.split(content, LINE_END, -1), "")


def newline_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))


def replace_matches(content: Column, pattern: str, rewrite, marks: list[str] | None = None) -> Column:
    """Rewrite every match of a pattern; texts without a match are only tested. Every match holds one of ``marks``, if given."""
    def found(c: Column) -> Column:
        likely = reduce(lambda x, y: x | y, [c.contains(m) for m in marks]) if marks else None
        return c.rlike(pattern) if likely is None else likely & c.rlike(pattern)
    return let(content, lambda c: F.when(found(c), _rewritten(c, pattern, rewrite)).otherwise(c))


def _rewritten(content: Column, pattern: str, rewrite) -> Column:
    # The pieces between matches, zipped with the rewritten matches.
    between = F.split(content, pattern, -1)
    matches = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    rewritten = F.concat(F.transform(matches, lambda hit: rewrite(hit)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, rewritten, lambda gap, hit: F.concat(gap, hit)), "")


def mask_all(match: Column, fill: str = "*", keep: str = r"\r\n") -> Column:
    return F.regexp_replace(match, f"[^{keep}]", fill)


def mask_middle(pattern: str):
    def rewrite(match: Column) -> Column:
        secret = F.regexp_extract(match, pattern, 2)
        return F.concat(F.regexp_extract(match, pattern, 1), F.repeat(F.lit("*"), F.length(secret)),
                        F.regexp_extract(match, pattern, 3))
    return rewrite


def redact(content: Column) -> Column:
    """Secrets replaced by asterisks of equal length, line breaks kept."""
    for pattern, grouped in SECRET_PATTERNS:
        content = replace_matches(content, pattern, mask_middle(pattern) if grouped else mask_all, SECRET_MARKS.get(pattern))
    return content


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


# An alphanumeric part: it ends where a capital follows a small letter or digit.
WORD = "[A-Z]+[a-z0-9]*|[a-z0-9]+"


def word_parts(value: Column) -> Column:
    """Lower-case alphanumeric parts in order, camel case split, duplicates kept."""
    return F.transform(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), F.lower)


def word_total(value: Column) -> Column:
    """How many parts ``word_parts`` gives."""
    return F.regexp_count(value, F.lit(WORD))


_RUNS = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))     # all bytes that no part holds become blanks
_PARTS = re.compile(WORD.encode()).findall
KNOWN_RUNS = 2**18     # runs whose value a worker keeps


class RunValues(dict):
    """What ``make`` gives for the lower-case parts of a run of letters and digits; forgotten when there are many runs."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, run: bytes):
        if len(self) >= KNOWN_RUNS:
            self.clear()
        self[run] = value = self.make([run] if run == run.lower() else [part.lower() for part in _PARTS(run)])
        return value


def runs(said: bytes) -> Counter:
    """How often each run of ASCII letters and digits stands in a text."""
    return Counter(said.translate(_RUNS).split())


def word_counts(rows: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """A row for each row and each different part of its text: the keys, length (all its parts), term, tf. Texts are counted in
    their Arrow batch and never shuffled."""
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RunValues(list)
        for batch in batches:
            at, lengths, terms, counts = [], [], [], []
            for row, said in enumerate(batch.column("_said").cast(pa.binary()).to_pylist()):
                own = {}
                for run, n in runs(said or b"").items():
                    for part in known[run]:
                        own[part] = own.get(part, 0) + n
                at += [row] * len(own)
                lengths += [sum(own.values())] * len(own)
                terms += own
                counts += own.values()
            taken = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], [*keys, "length", "term", "tf"])
    return rows.select(*keys, source.alias("_said")).mapInArrow(counted, ", ".join([*kinds, "length long", "term string", "tf long"]))


def search_terms(value: Column) -> Column:
    return F.array_distinct(word_parts(value))


def trimmed_length(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"^\s+|\s+$", ""))
