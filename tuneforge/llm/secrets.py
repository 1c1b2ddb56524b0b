"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty of strings in context.

Base kinds are ``assign``, ``access`` and ``hex``. The method adds ``novel``: a candidate is a whole run
of 16 or more key characters that begins at most ``REACH`` bytes after a sensitive cue or ends at most so
many before it, in whatever line (of a name that holds the cue, what stands behind it), or that follows a reported string with nothing but white space between (values of several
lines). It is compressed after its surroundings (``CONTEXT`` bytes on either side, less its own copies), by a
compressor primed with a dictionary of identifiers: a fixed list of code words and the ``DICTIONARY``
most frequent words of the corpus (counted over all documents). The bytes it adds to the
compressed size, over its length, are its novelty. Text that consists of known identifiers or of what
stands around it adds little; keys and passwords add nearly their length and are reported, each copy.

Limits, all parameters: 16 characters, ``REACH``, ``CONTEXT``, ``DICTIONARY`` and the threshold (0.6: random keys of
nine forms score 0.75 or more, see the tests). Runs without a cue in reach are not judged.

Null texts are empty and give no spans. Offsets are code points, end exclusive. Rows that
repeat are each judged alone; null doc_ids and extra columns do not matter. A text is searched
whole, in time proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import text_or_empty

KINDS = ["assign", "access", "hex", "novel"]
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string,novelty:double>>"

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
ASSIGN_CUES = [b"passw", b"secret", b"token", b"api"]

# Cues of a sensitive context, and identifiers that prime the compressor.
CUES = [b"passw", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"credential", b"private_key", b"private key", b"access_key", b"auth_key", b"bearer", b"aws_"]
IDENTIFIERS = """
access account address algorithm amount application argument array assert async attribute author await backend base
boolean buffer button bytes cache callback category channel character class client code collection column command
comment commit component config configuration connection console const constant constructor container content context
control controller cookie count counter create current customer data database datetime debug default definition delete
description destination dictionary directory document domain double element email enable encoding endpoint engine entity
environment error event example exception execute export expression extension factory field file filter float folder
format function generate getattr handler hash header height helper hidden host identifier image implements import index
init input insert instance int integer interface internal item iterator java javascript json kernel key label language
length library limit link list listener load local location logger login manager mapping master member memory message
metadata method middleware model module modified monitor name namespace network node null number object offset operation
option order output override package page parameter parent parse partition password path pattern payload permission
pointer policy port position primary private process product profile project properties protected protocol provider
proxy public python query queue random range read record reference register remote render replace repository request
required resource response result return role route runtime schema scope script search secret section select self
sequence server service session setting signature size socket source stack start state static status storage stream
string struct style submit subscribe success super switch system table target task template test text thread timeout
timestamp title token transaction true type undefined unique unit update upload user username utils valid validate
value variable vector version view virtual void widget width window worker write xml yaml
""".split()
MIN_KEY = 16
CANDIDATE, RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}"), re.compile(rb"[A-Za-z0-9+/_.=-]+")
KEY_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAME = re.compile(rb"(?:[A-Za-z_.-]*=+)?")
BLANK = re.compile(rb"[\x20\t\r\n]{0,16}")
#: Bytes between a cue and a candidate, bytes of surroundings on either side, words of the corpus that prime the compressor.
REACH, CONTEXT, DICTIONARY = 48, 256, 4096


def _starts(data: bytes, cue: bytes) -> Iterator[int]:
    at = data.find(cue)
    while at >= 0:
        yield at
        at = data.find(cue, at + 1)


class Novelty:
    """Marginal compressed bytes of a candidate, over its length."""

    def __init__(self, corpus_words: list[str] = (), level: int = 3):
        import zstandard

        words = "\n".join([*corpus_words, *IDENTIFIERS, *(w.upper() for w in IDENTIFIERS), *(w.capitalize() for w in IDENTIFIERS)]).encode()
        prior = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prior.precompute_compress(level=level)
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=prior, write_content_size=False).compress

    def __call__(self, around: bytes, candidate: bytes) -> float:
        return (len(self._compress(around + candidate)) - len(self._compress(around))) / len(candidate)


def base_spans(data: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, by the fixed patterns; ``low``: data with A-Z folded."""
    found = []
    cues = sorted({at for cue in ASSIGN_CUES for at in _starts(low, cue)})
    done = 0
    for at in cues:
        if at >= done and (m := ASSIGN.match(data, at)):
            done = m.end()
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((m.start(), 0, m.end()))
    done = 0
    for at in _starts(data, b"AKIA"):
        if at >= done and (m := ACCESS.match(data, at)):
            done = m.end()
            if done - at >= MIN_ACCESS:
                found.append((at, 1, done))
    found.extend((m.start(), 2, m.end()) for m in HEX.finditer(data))
    return found


def near_cues(low: bytes, reach: int) -> list[tuple[int, int]]:
    """Stretches within reach of a cue, merged."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((at, at + len(cue)) for cue in CUES for at in _starts(low, cue)):
        if out and begin - reach <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end + reach)
        else:
            out.append((begin - reach, end + reach))
    return out


def novel_spans(data: bytes, low: bytes, novelty: Novelty, threshold: float, context: int = CONTEXT, reach: int = REACH) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, novelty) of incompressible strings within reach of a cue."""
    found, done = [], 0
    for begin, until in near_cues(low, reach):
        pos = max(done, begin)
        while pos > done and data[pos - 1] in KEY_BYTES:  # a run that ends within reach counts whole
            pos -= 1
        while m := CANDIDATE.search(data, pos, until + MIN_KEY):
            start, stop = m.start(), RUN.match(data, m.start()).end()
            pos = done = stop
            if (inner := max(low.rfind(cue, start, stop) + len(cue) if cue in low[start:stop] else 0 for cue in CUES)) > start:
                start = NAME.match(data, inner, stop).end()  # a name with a cue: what stands behind it
                if stop - start < MIN_KEY:
                    continue
            value = data[start:stop]
            score = novelty((data[max(0, start - context) : start] + data[stop : stop + context]).replace(value, b""), value)
            if score >= threshold:
                found.append((start, 3, stop, score))
                blank = BLANK.match(data, stop).end()  # a value of several lines goes on behind white space
                until = max(until, blank)
    return found


def _scan(threshold: float, corpus_words: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(corpus_words)
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("novelty", pa.float64())])))])
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for k in range(len(texts)):
                data = texts[k].as_py()
                low = data.lower()
                spans = [(a, k2, b, None) for a, k2, b in base_spans(data, low)] + novel_spans(data, low, novelty, threshold)
                rows.append(_points(data, sorted(spans, key=lambda s: s[:3])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, schema.field("spans").type)], schema=schema)
    return run


def _points(data: bytes, spans: list[tuple]) -> list[dict]:
    """Byte offsets as code points, in one pass over the text."""
    if not spans:
        return []
    at = {}
    if data.isascii():
        at = {p: p for s in spans for p in (s[0], s[2])}
    else:
        pos = points = 0
        for p in sorted({p for s in spans for p in (s[0], s[2])}):
            points += len(data[pos:p].decode("utf-8", "replace"))
            at[p], pos = points, p
    return [{"kind": KINDS[k], "start": at[a], "end": at[b], "value": data[a:b].decode("utf-8", "replace"), "novelty": score} for a, k, b, score in spans]


def corpus_words(docs: DataFrame, n: int = DICTIONARY) -> list[str]:
    """The ``n`` most frequent words (4 to 40 letters or underscores) of all documents that occur twice
    or more, the most frequent last (nearest to what the compressor reads)."""
    words = docs.select(F.explode(F.regexp_extract_all(text_or_empty(), F.lit("[A-Za-z_]{4,40}"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(n).collect()  # n rows
    return [r["word"] for r in reversed(top)]


def find_secrets(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id and the spans of each text, by start and kind, with values and novelty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(_scan(threshold, corpus_words(docs)), SCHEMA)
