"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

The windows of a candidate are computed by incremental counts: moving by one character changes two counts,
so a window costs two table look-ups. Candidates and windows that look like ordinary material (words, paths,
counters, well-known examples) are suppressed by an allow-list. Runs of windows above the class's threshold
become spans.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import as_text, fresh

# fixed values of the base patterns; in `assign` letters of the names count in either case (ASCII only)
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")          # [0-9a-f]+ takes whole runs, so runs of 24+ are its matches of 24+
MIN_ASSIGN, MIN_ACCESS = 6, 20
BASE_KINDS = ("assign", "access", "hex")

#: class -> (its characters, window, least bits per character in the window)
CLASSES = {"entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
           "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.8)}
#: Allow-list for the part of a candidate that holds one of these, see :func:`excused`.
PLACEHOLDER = re.compile(r"(?i:example|sample|placeholder|changeme|xxxx|dummy)")
MOST_EXCUSED = 40                            # characters
#: Allow-list for windows: one that any of these finds is not reported.
ALLOWED = [re.compile(p) for p in (
    r"^[^0-9]*$",                            # no digit: words, identifiers, paths
    r"^[^A-Za-z]*$",                         # no letter: numbers, dates, rulers
    r"(?i:https?|www)|[a-z]{10}",             # a long run of small letters inside: words joined to a number
    r"(?:[/_-][^/_-]*){3}",                  # paths and joined identifiers
    r"01234567|12345678|abcdefgh|ABCDEFGH",  # counters and alphabets
    r"(.)\1{4}",                             # five equal characters
)]
KINDS = (*BASE_KINDS, *CLASSES)
_ANY_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_TOKEN, _SEGMENT = re.compile(r"[^=]+"), re.compile(r"[A-Za-z0-9]+")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)+[0-9]{0,3}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, each kind leftmost and non-overlapping, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def high_entropy(chars: str, window: int, least: float) -> list[int]:
    """Starts of the windows of ``chars`` whose Shannon entropy is at least ``least`` bits per character."""
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    limit = window * (math.log2(window) - least) + 1e-9      # H >= least as a bound on the sum of c log2 c
    count: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(chars):
        k = count.get(c, 0)
        total += term[k + 1] - term[k]
        count[c] = k + 1
        if i >= window:
            gone = chars[i - window]
            k = count[gone]
            total += term[k - 1] - term[k]
            count[gone] = k - 1
        if i >= window - 1 and total <= limit:
            out.append(i - window + 1)
    return out


def excused(run: str, window: int) -> bytearray | None:
    """1 at the starts of the windows of ``run`` that a placeholder excuses, None if there is no placeholder.

    A placeholder excuses its segment between ``+ / _ = -``, and, when the segment is not plain words (as in a key with EXAMPLE
    inside), its whole token between ``=``. Both up to MOST_EXCUSED characters: in a longer segment only the windows that
    hold the placeholder, in a longer token only the segment.
    """
    if not PLACEHOLDER.search(run):
        return None
    off = bytearray(len(run))
    for token in _TOKEN.finditer(run):
        for part in _SEGMENT.finditer(run, token.start(), token.end()):
            if part.end() - part.start() > MOST_EXCUSED:
                for m in PLACEHOLDER.finditer(run, part.start(), part.end()):
                    for i in range(max(0, m.end() - window), m.start() + 1):
                        off[i] = 1
            elif PLACEHOLDER.search(part[0]):
                whole = token.end() - token.start() <= MOST_EXCUSED and not _WORDS.fullmatch(part[0])
                a, b = token.span() if whole else part.span()
                for i in range(max(0, a - window + 1), b):
                    off[i] = 1
    return off


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end): joined runs of high-entropy windows, allow-listed windows left out."""
    out = []
    for long in _ANY_LONG.finditer(text):
        if not any(c.isdigit() for c in long[0]):   # no window without a digit counts
            continue
        for number, (pattern, window, least) in enumerate(CLASSES.values(), len(BASE_KINDS)):
            off = excused(long[0], window)
            for m in pattern.finditer(text, long.start(), long.end()):
                run: list[int] = []
                for i in high_entropy(m[0], window, least):
                    at = m.start() + i
                    if off and off[at - long.start()] or any(a.search(m[0][i:i + window]) for a in ALLOWED):
                        continue
                    if run and at <= run[1]:
                        run[1] = at + window
                    else:
                        if run:
                            out.append((run[0], number, run[1]))
                        run = [at, at + window]
                if run:
                    out.append((run[0], number, run[1]))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one whole text, each by start, then kind. Entropy spans inside a base span are dropped."""
    base = sorted(base_spans(text))
    more, reach, k = [], -1, 0
    for span in sorted(entropy_spans(text)):
        while k < len(base) and base[k][0] <= span[0]:
            reach = max(reach, base[k][2])
            k += 1
        if span[2] > reach:
            more.append(span)
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string,n_entropy:long>"


def _scan_columns(column: pa.Array) -> pa.Array:
    cols: list[list] = [[] for _ in range(6)]
    for text in as_text(column):
        base, spans = scan(text)
        for k in range(3):
            cols[k].append(sum(s[1] == k for s in base))
        cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        cols[4].append(_joined(spans))
        cols[5].append(sum(s[1] >= 3 for s in spans))
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Offsets are code points, ends exclusive. Null or empty text has no spans (the sha256 of nothing); ids may repeat
    or be null; an empty table gives an empty result; other columns are not read. One pass, no shuffle.
    """
    return (docs.select(F.col(doc_id).alias("doc_id"), arrow_udf(_scan_columns, _FOUND)(F.col(text)).alias("s"))
            .select("doc_id", "s.*"))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every found span replaced by ``mark``; overlapping spans become one mark."""
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def without_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced by ``mark`` and ``n_chars`` counted anew where they were.

    Texts without a secret, null text included, stay as they are. ``n_chars`` is left alone if there is no such column.
    """

    @arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redact(t, mark) for t in column.to_pylist()], pa.string())

    old, = fresh(docs, "_old_text")
    out = docs.withColumn(old, F.col(text)).withColumn(text, clean(F.col(old)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(old).eqNullSafe(F.col(text)), F.col(n_chars))
                             .otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
