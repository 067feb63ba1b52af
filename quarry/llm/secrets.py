"""Secrets in texts: three fixed patterns, and strings that zstandard finds new in a sensitive context.

The base patterns are matched as they stand. The method adds candidates: values of 16 or more
characters after a name that speaks of keys or credentials, and all runs of ``MIN_RUN`` token characters
or more within ``REACH`` characters of such a name, or of a candidate that is reported, on either side.
A candidate's novelty is the number of bytes that it adds to its compressed surroundings, with a
compressor primed by a dictionary of identifiers, placeholders and alphabets that code and
documentation use. Prose, names, paths and placeholders repeat what is there and add little; keys
do not. A candidate is reported if it adds ``MIN_RATIO`` bytes or more for each of its own.

The search is linear in the text: a name is read once up to its end, whatever words it holds, known spans are merged
before candidates are held against them, and a candidate costs two compressions of itself and at most twice
``CONTEXT`` characters. There are at most a candidate for each ``MIN_RUN`` characters.

Nulls: a null text is empty and has no spans; a null ``doc_id`` stays. Whole texts of any length are searched;
spans count code points. Ties: spans that begin at one place are in the order of ``KINDS``; of a value that two patterns
find, both spans are told, and it is redacted once. Repeated rows get one result each. An empty table gives no rows;
``scan`` reads ``doc_id`` and ``text`` alone, ``without_secrets`` returns all other columns, whatever their names, as they are.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Names that make a context sensitive.
_SENSITIVE = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature", "salt", "private")
#: The rest of a name, and what follows one up to the end of its value. Neither reads a character twice.
_TAIL = re.compile(r"[\w.-]*+", re.A)
_VALUE = re.compile(r"""["']?[ \t]{0,4}(?:[:=]{1,2}>?|[ \t])[ \t]{0,4}["']?([A-Za-z0-9+/_.=~$!@%^&*-]{16,})""", re.A)
_WORD = re.compile("|".join(_SENSITIVE), re.I | re.A)
#: Runs that may be a secret; an equals sign is padding at the end.
MIN_RUN = 12
_RUN = re.compile(r"[A-Za-z0-9+/_.~$!@%%^&*-]{%d,}={0,2}" % MIN_RUN)
#: Runs that are left out of a candidate's surroundings: the other lines of a key would make its own ones look usual.
LONG_RUN = 40
_LONG = re.compile(r"[A-Za-z0-9+/=]{%d,}" % LONG_RUN)
#: Characters between a sensitive word and a run that it makes a candidate.
REACH = 100
CONTEXT = 200
MIN_RATIO = 0.72
#: Identifiers, placeholders and alphabets of code and documentation, for the compressor's dictionary.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key client_secret client_id "
    "authorization bearer basic credential credentials signature salt session username user email localhost example "
    "changeme placeholder your_password_here your_api_key_here xxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 function return import from class public static void "
    "string integer boolean config settings environment os.environ process.env getenv http https www com org net html json "
    "application content-type license version copyright description default value name path file directory index database "
)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard as zstd

    return zstd.ZstdCompressor(level=6, dict_data=zstd.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), write_checksum=False)


def novelty(before: str, candidate: str, after: str) -> int:
    """Bytes that the candidate adds to its compressed surroundings."""
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "surrogatepass")))
    return size(before + after + candidate) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def untouched(spans: list[tuple[int, int]], known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Sorted spans without those that share a character with a known one (sorted)."""
    out, k, reach = [], 0, 0
    for start, end in spans:
        while k < len(known) and known[k][0] < end:
            reach, k = max(reach, known[k][1]), k + 1
        if reach <= start:
            out.append((start, end))
    return out


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of incompressible candidates that no base span touches."""
    low = text.lower()
    if not any(w in low for w in _SENSITIVE):
        return []
    marks = [m.span() for m in _WORD.finditer(text)]
    named, read = [], 0
    for _, end in marks:
        if end > read:
            read = _TAIL.match(text, end).end()
            value = _VALUE.match(text, read)
            if value:
                named.append(value.span(1))
                read = value.end()
    runs, k = [], 0
    for m in _RUN.finditer(text):
        while k < len(named) and named[k][1] <= m.start():
            k += 1
        if k == len(named) or named[k][0] >= m.end():
            runs.append(m.span())
    places = untouched(sorted(named + runs), known)
    new: dict[tuple[int, int], bool] = {}

    def is_new(span: tuple[int, int]) -> bool:
        if span not in new:
            start, end = span
            before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
            if len(before) + len(after) >= LONG_RUN:
                before, after = _LONG.sub("", before), _LONG.sub("", after)
            new[span] = novelty(before, text[start:end], after) >= MIN_RATIO * (end - start)
        return new[span]

    # What is within reach of a word or a reported run before it, then of one after it.
    found, at, k = set(named) & set(places), -REACH - 1, 0
    found = {x for x in found if is_new(x)}
    for span in places:
        while k < len(marks) and marks[k][0] < span[1]:
            at, k = max(at, marks[k][1]), k + 1
        if span in found or span[0] - at <= REACH and is_new(span):
            found.add(span)
            at = max(at, span[1])
    at, k = len(text) + REACH + 1, len(marks) - 1
    for span in reversed(places):
        while k >= 0 and marks[k][1] > span[0]:
            at, k = min(at, marks[k][0]), k - 1
        if span in found or at - span[1] <= REACH and is_new(span):
            found.add(span)
            at = min(at, span[0])
    return [(start, end, "novel") for start, end in sorted(found)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_novel of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
            for text in batch.column(1):
                base, every = find(text.as_py())
                for kind in KINDS[:3]:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(every))
                rows["n_novel"].append(len(every) - len(base))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items())], names=["doc_id", *rows])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redacted(text: str) -> str:
    """The text with each secret's value replaced by a mark."""
    out, at = [], 0
    for start, end, kind in find(text)[1]:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        out.append(f"[{kind}]")
        at = end
    return "".join(out) + text[at:]


def without_secrets(documents: DataFrame) -> DataFrame:
    """The documents with secrets redacted in ``text`` and ``n_chars`` counted anew; texts without any stay as they are."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = documents.mapInArrow(lean(run), documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
